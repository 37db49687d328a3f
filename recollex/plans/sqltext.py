"""The text functions in DuckDB SQL."""

from recollex import consts as K
from recollex.tables import quoted

CJK = r"[\x{4e00}-\x{9fff}]"


def sql_list(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def tokens(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '{CJK}|[a-z0-9]+')"


def scene_tokens(c: str) -> str:
    found = rf"list_concat(regexp_extract_all({c}, '{CJK}{{2,}}'), regexp_extract_all({c}, '[a-zA-Z][a-zA-Z0-9]{{2,}}'))"
    return f"list_filter(list_transform({found}, lambda t: lower(t)), lambda t: NOT list_contains({sql_list(K.SCENE_STOP)}, t) AND length(t) >= 3)"


def keywords(c: str) -> str:
    found = rf"list_concat(regexp_extract_all(lower({c}), '{CJK}{{2,4}}'), regexp_extract_all(lower({c}), '[a-z]{{3,}}'))"
    return f"list_distinct(list_filter({found}, lambda t: NOT list_contains({sql_list(K.KEYWORD_STOP)}, t)))"


def entities(c: str) -> str:
    names = rf"regexp_extract_all({c}, '[A-Z][a-z]+ [A-Z][a-z]+(?:\s[A-Z][a-z]+)*')"
    return f"list_distinct(list_concat(list_transform(list_concat({names}, regexp_extract_all({c}, '\"([^\"]{{2,}})\"', 1)), lambda x: lower(x)), regexp_extract_all({c}, '「([^」]{{2,}})」', 1)))"


def cjk_topics(c: str) -> str:
    known, stop, verbs = (sql_list(x) for x in (K.CJK_TOPICS, K.CJK_TOPIC_STOP, K.CJK_SPEECH))
    grams = lambda n: f"list_transform(range(1, greatest(length(r) - {n - 2}, 1)), lambda i: substr(r, i, {n}))"
    two = f"list_filter({grams(2)}, lambda w: list_contains({known}, w))"
    three = f"list_filter({grams(3)}, lambda w: NOT list_contains({known}, left(w, 2)) AND NOT list_contains({known}, right(w, 2)) AND NOT list_contains({stop}, w))"
    four = f"list_filter({grams(4)}, lambda w: NOT list_contains({known}, left(w, 2)) AND NOT list_contains({verbs}, right(w, 2)) AND NOT list_contains({stop}, w) AND NOT list_contains({three}, left(w, 3)))"
    return f"flatten(list_transform(regexp_extract_all({c}, '{CJK}{{2,}}'), lambda r: list_concat(list_concat({two}, {three}), {four})))"


def topics(c: str) -> str:
    q = rf"list_transform(regexp_extract_all({c}, '[“”「」\"]([^“”「」\"]{{2,20}})[“”「」\"]', 1), lambda x: trim(x))"
    n = rf"regexp_extract_all({c}, '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){{0,2}}\b')"
    w = rf"list_filter(regexp_extract_all({c}, '\b[A-Za-z]{{2,}}[0-9]{{0,2}}\b'), lambda x: length(x) >= 3 AND lower(x) NOT IN ('the', 'and', 'for', 'was', 'are', 'not', 'you'))"
    return f"list_sort(list_filter(list_distinct(list_concat({q}, {n}, {cjk_topics(c)}, {w})), lambda x: length(x) >= 2))[1:20]"


def buckets(c: str) -> str:
    s = f"lower(substr({c}, 1, 512))"
    code = lambda i: f"unicode(substr(s, {i}, 1))"
    return f"(SELECT list_distinct(list_transform(range(1, greatest(length(s) - 1, 1)), lambda i: (({code('i')} * 31 + {code('i + 1')}) * 31 + {code('i + 2')}) % 256)) FROM (SELECT {s} AS s))"


def sentiment(c: str) -> str:
    neg = [f"CASE WHEN regexp_matches({c}, '({K.NEGATION})\\s*{w}') THEN 2 ELSE 0 END" for w in K.POSITIVE] + [f"CASE WHEN contains({c}, '{w}') THEN 1 ELSE 0 END" for w in K.NEGATIVE]
    pos = [f"CASE WHEN NOT regexp_matches({c}, '({K.NEGATION})\\s*{w}') AND contains({c}, '{w}') THEN 1 ELSE 0 END" for w in K.POSITIVE]
    p, n = " + ".join(pos), " + ".join(neg)
    return f"CASE WHEN ({p}) > ({n}) THEN 'positive' WHEN ({n}) > ({p}) THEN 'negative' ELSE 'neutral' END"


def joined(c: str) -> str:
    return f"array_to_string(list_sort({c}), '|')"

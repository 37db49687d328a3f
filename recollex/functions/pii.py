"""PII: ordered rewrites and label scans as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollex.functions.text import held

_D = "(?<!\\d)", "(?!\\d)"
# Fixed values: (pattern, replacement, label); the second list is scanned in the original text but rewritten after the first
CN_RULES = (
    (rf"{_D[0]}(1[3-9]\d)\s?[-–—]?\s?(\d{{4}})\s?[-–—]?\s?(\d{{4}}){_D[1]}", "$1****$3", "phone_cn"),
    (rf"{_D[0]}(\d{{4}})\d{{10}}(\d{{4}}){_D[1]}", "$1**********$2", "id_card_cn"),
    (rf"{_D[0]}(\d{{4}})\d{{9}}(\d{{4}}[\dXx]){_D[1]}", "$1*********$2", "id_card_cn"),
    (rf"{_D[0]}(\d{{4}})\d{{8,11}}(\d{{4}}){_D[1]}", "$1***********$2", "bank_card_cn"),
    (rf"{_D[0]}(0\d{{2,3}})[-–—\s]?(\d{{4}})\d{{4}}{_D[1]}", "$1-$2****", "landline_cn"),
)
EN_RULES = (
    (r"([\w.+-]+)@([\w-]+\.[\w.]+)", None, "email"),
    (rf"{_D[0]}(\+\d{{1,3}})[-.\s]?\d{{2,4}}[-.\s]?\d{{2,4}}[-.\s]?\d{{3,10}}{_D[1]}", None, "phone_intl"),
    (r"\(\d{3}\)\s?\d{3}[-.\s]?(\d{4})", r"(***) ***-$1", "phone_intl"),
    (rf"{_D[0]}(\d{{4}})[-–—\s]?(\d{{4}})[-–—\s]?(\d{{4}})[-–—\s]?(\d)\d{{3}}{_D[1]}", "$1-$2-$3-$4***", "credit_card"),
    (rf"{_D[0]}(\d{{1,3}})\.(\d{{1,3}})\.(\d{{1,3}})\.(\d{{1,3}}){_D[1]}", None, "ip_address"),
    (rf"{_D[0]}(\d{{3}})[-–—](\d{{2}})[-–—](\d{{4}}){_D[1]}", "***-**-$3", "ssn"),
    (r"(?<![a-zA-Z0-9])((?:sk-|ark-|AKID|AKTP|ghp_|gho_|ghu_)[a-zA-Z0-9_-]{16,})(?![a-zA-Z0-9_-])", None, "api_key"),
)


RULES = CN_RULES + EN_RULES
#: For each rule a cheap test that every text it matches passes: (what it must contain, a short pattern).
NEEDS = (
    (None, r"1[3-9]\d"), (None, r"\d{18}"), (None, r"\d{17}"), (None, r"\d{16}"), (None, r"0\d{2}"), ("@", None), ("+", r"\+\d"), (")", r"\(\d{3}\)"), (None, r"\d{4}[-–—\s]?\d{4}"),
    (".", r"\d\.\d"), (None, r"\d[-–—]\d\d[-–—]\d"), (None, "sk-|ark-|AK[IT]|gh[pou]_"),
)


#: What every text that any rule matches holds; no rewrite makes runs of digits longer, so this is asked of the original text.
_ANY_DIGITS, _ANY_KEY = r"\d(?:\d\d|\.\d)", NEEDS[-1][1]


def _any(c: Column) -> Column:
    return F.contains(c, F.lit("@")) | c.rlike(_ANY_DIGITS) | c.rlike(_ANY_KEY)


def _matches(c: Column, i: int) -> Column:
    """Whether rule i matches. Most texts fail the cheap test, so that the rule's own pattern, with its neighbours and
    options, is rarely tried."""
    word, short = NEEDS[i]
    hit = c.rlike(RULES[i][0])
    if short is not None:
        hit = c.rlike(short) & hit
    return F.contains(c, F.lit(word)) & hit if word is not None else hit


def _rewrite(c: Column, i: int) -> Column:
    """The text after rule i."""
    pattern, to, label = RULES[i]
    if label == "email":  # one-letter names vanish, longer ones keep their first letter
        c = F.regexp_replace(c, r"(?<![\w.+-])[\w.+-]@([\w-]+\.[\w.]+)", "*@$1")
        return F.regexp_replace(c, r"([\w.+-])[\w.+-]+@([\w-]+\.[\w.]+)", "$1***@$2")
    if to is None and label == "phone_intl":  # the last four characters of the whole number stay
        whole = r"[-.\s]?\d{2,4}[-.\s]?\d{2,4}[-.\s]?\d{3,10}(?!\d)"
        return F.regexp_replace(c, rf"{_D[0]}(\+\d{{1,3}})(?={whole})[-.\s]?\d{{2,4}}[-.\s]?\d{{2,4}}(?:[-.\s]?\d{{0,6}}?)((?:\d{{4}}|[-.\s]\d{{3}})){_D[1]}", "$1-***-$2")
    if label == "ip_address":  # only the first number is checked
        return F.regexp_replace(c, rf"{_D[0]}(25[0-5]|2[0-4]\d|1\d\d|0?\d?\d)\.(\d{{1,3}})\.\d{{1,3}}\.\d{{1,3}}{_D[1]}", "$1.$2.***.***")
    if label == "api_key":
        return F.regexp_replace(c, r"(?<![a-zA-Z0-9])(sk-[a-zA-Z0-9_-]|ark-|AKID|AKTP|ghp_|gho_|ghu_)[a-zA-Z0-9_-]{11,}([a-zA-Z0-9_-]{4})(?![a-zA-Z0-9_-])", "$1***$2")
    if i == 2:  # a final x becomes X
        c = F.regexp_replace(c, pattern.replace("(\\d{4}[\\dXx])", "(\\d{4})[xX]"), "$1*********$2X")
        return F.regexp_replace(c, pattern.replace("[\\dXx]", "\\d"), "$1*********$2")
    return F.regexp_replace(c, pattern, to)


def _chain(rows: DataFrame, start: str, rules: range, tag: str) -> tuple[DataFrame, str, list[Column]]:
    """Columns of the text before each rule, so that each is computed once; the last one's name; labels in rule order. A text
    that a rule doesn't match is not rewritten, and one that holds nothing of what any rule needs (__any) meets no rule. The
    plan refers to each text more than once, which joins above it would multiply, so this is for scans alone."""
    at, labels = start, []
    for i in rules:
        hit = f"__{tag}hit{i}"
        rows = rows.withColumn(hit, held(F.col("__any") & _matches(F.col(at), i)))
        labels.append(F.when(F.col(hit), F.lit(RULES[i][2])))
        rows = rows.withColumn(f"__{tag}{i}", held(F.when(F.col(hit), _rewrite(F.col(at), i)).otherwise(F.col(at))))
        at = f"__{tag}{i}"
    return rows, at, labels


def _distinct(labels: list[Column]) -> Column:
    return F.array_distinct(F.filter(F.array(*labels), lambda x: x.isNotNull()))


def _step(i: int):
    """Rule i over a (text, labels). Keys are rewritten from a length on that has no label yet, so the last rule asks for its
    cheap test alone."""
    label, key = RULES[i][2], RULES[i][2] == "api_key"

    def step(x: Column) -> Column:
        hit, more = _matches(x["t"], i), F.array_append(x["l"], label)
        new = F.struct(_rewrite(x["t"], i).alias("t"), (F.when(hit, more).otherwise(x["l"]) if key else more).alias("l"))
        return F.when(x["t"].rlike(NEEDS[i][1]) if key else hit, new).otherwise(x)

    return step


def with_redaction(rows: DataFrame, body: str = "text") -> DataFrame:
    """rows with redacted and redacted_types: all rules in order, each on what those before left. The rules are steps over an
    array of one (text, labels), which refer to each text once; a rule rewrites only what it matches, and a text that holds
    nothing of what any rule needs is left as it is."""
    none = F.array().cast("array<string>")
    start = F.array(F.struct(F.col(body).alias("t"), none.alias("l")))
    done = start
    for i in range(len(RULES)):
        done = F.transform(done, _step(i))
    out = rows.withColumn("__r", held(F.element_at(F.when(_any(F.col(body)), done).otherwise(start), 1)))
    return out.select(*rows.columns, F.col("__r.t").alias("redacted"), F.array_distinct("__r.l").alias("redacted_types"))


def with_scan(rows: DataFrame, body: str = "text") -> DataFrame:
    """rows with types: the labels of the first list of rules and those of the second, which starts from the original
    text again. Within a list, each rule sees what those before left."""
    n = len(CN_RULES)
    out, _, first = _chain(rows.withColumn("__any", held(_any(F.col(body)))), body, range(n), "c")
    out, _, second = _chain(out, body, range(n, len(RULES)), "e")
    return out.select(*rows.columns, held(_distinct(first + second)).alias("types"))


def redact(c: Column) -> Column:
    """The text after all rules, as one expression."""
    for i in range(len(RULES)):
        c = _rewrite(c, i)
    return c

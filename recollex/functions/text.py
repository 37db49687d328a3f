"""Text functions as Column expressions; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recollex import consts as K

CJK = "[\\x{4e00}-\\x{9fff}]"


def find_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def constant_list(values) -> Column:
    """An array of strings as one constant."""
    return F.split(F.lit("\x1f".join(values)), "\x1f")


def trimmed(c: Column) -> Column:
    """Without the separators of any script at its ends (a no-break or wide space among them), as SQL trims."""
    return F.regexp_replace(c, r"^\p{Zs}+|\p{Zs}+\z", "")


def _runs(c: Column, between: str) -> Column:
    """The runs of characters that `between` (a pattern) doesn't match. Splitting takes a tenth of the time of collecting
    a pattern's matches."""
    return F.filter(F.split(c, between), lambda w: w != "")


def _by_script(c: Column, pattern: str, ascii_runs: Column) -> Column:
    """All matches of a pattern; ascii_runs, which are the same, where the text has no CJK character."""
    return F.when(c.rlike(CJK), find_all(c, pattern)).otherwise(ascii_runs)


def tokens(c: Column) -> Column:
    """Single CJK characters and runs of ASCII letters and digits, lower-cased."""
    low = F.lower(c)
    return _by_script(low, f"{CJK}|[a-z0-9]+", _runs(low, "[^a-z0-9]+"))


def scene_tokens(c: Column, least: int = K.SCENE_MIN_LENGTH) -> Column:
    """CJK runs of two and more and words of at least `least` characters that begin with a letter, without stop words."""
    words = F.transform(_runs(c, "[^a-zA-Z0-9]+"), lambda w: F.regexp_replace(F.lower(w), "^[0-9]+", ""))
    cjk = F.when(c.rlike(CJK), find_all(c, f"{CJK}{{2,}}")).otherwise(F.array().cast("array<string>"))
    return F.filter(F.concat(cjk, words), lambda t: (F.length(t) >= least) & ~t.isin(*K.SCENE_STOP))


def keywords(c: Column) -> Column:
    """Distinct CJK chunks of two to four characters and ASCII words of three letters and more, without stop words."""
    low = F.lower(c)
    words = F.filter(F.split(low, "[^a-z]+"), lambda w: F.length(w) >= 3)
    cjk = F.when(low.rlike(CJK), find_all(low, f"{CJK}{{2,4}}")).otherwise(F.array().cast("array<string>"))
    return F.array_except(F.concat(cjk, words), constant_list(K.KEYWORD_STOP))


def query_words(c: Column, least: int = 2) -> Column:
    """CJK runs and ASCII words for knowledge-file search."""
    low = F.lower(c)
    return _by_script(low, f"{CJK}{{2,}}|[a-z]{{{least},}}", F.filter(F.split(low, "[^a-z]+"), lambda w: F.length(w) >= least))


def entities(c: Column) -> Column:
    """Capitalised multi-word names and quoted terms, lower-cased and distinct."""
    names = find_all(c, r"[A-Z][a-z]+ [A-Z][a-z]+(?:\s[A-Z][a-z]+)*")
    return F.array_distinct(F.concat(F.transform(F.concat(names, find_all(c, '"([^"]{2,})"', 1)), F.lower), find_all(c, "「([^」]{2,})」", 1)))


def cjk_topics(c: Column) -> Column:
    """Topics of runs of CJK characters: known words of two; runs of three that neither begin nor end with a known word;
    runs of four that neither begin with one nor end with a verb of speech; no stop words."""
    known, stop, verbs = constant_list(K.CJK_TOPICS), constant_list(K.CJK_TOPIC_STOP), constant_list(K.CJK_SPEECH)
    is_in = F.array_contains

    def grams(run: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(run) - n + 1), lambda i: F.substring(run, i, F.lit(n)))

    def of(run: Column) -> Column:
        none = F.array().cast("array<string>")
        two = F.filter(grams(run, 2), lambda w: is_in(known, w))
        three = F.when(F.length(run) >= 3, F.filter(grams(run, 3), lambda w: ~is_in(known, F.left(w, F.lit(2))) & ~is_in(known, F.right(w, F.lit(2))) & ~is_in(stop, w))).otherwise(none)
        four = F.when(F.length(run) >= 4, F.filter(grams(run, 4), lambda w: ~is_in(known, F.left(w, F.lit(2))) & ~is_in(verbs, F.right(w, F.lit(2))) & ~is_in(stop, w) & ~is_in(three, F.left(w, F.lit(3))))).otherwise(none)
        return F.concat(two, three, four)

    return F.when(c.rlike(CJK), F.flatten(F.transform(find_all(c, f"{CJK}{{2,}}"), of))).otherwise(F.array().cast("array<string>"))


def topics(c: Column, most: int = 20) -> Column:
    """Topics for reflection: quoted terms, proper names of one to three words, terms of CJK runs and ASCII words of three
    letters and more (word borders as in ASCII, a vertical tab is no space); sorted, so that the cap of `most` is the same in
    every run. A null text has none.

    Capitals sort before small letters and all other scripts, so a text with `most` topics before those needs no further
    look: its words aren't split and its CJK runs aren't looked for."""
    c = F.coalesce(c, F.lit(""))
    quoted = F.transform(find_all(c, "[“”「」\"]([^“”「」\"]{2,20})[“”「」\"]", 1), trimmed)
    names = find_all(c, r"(?<!\w)[A-Z][a-z]+(?:[\t\n\f\r ]+[A-Z][a-z]+){0,2}(?!\w)")
    word = lambda w: (F.length(w) >= 3) & w.rlike("^[A-Za-z]{2,}[0-9]{0,2}$") & ~F.lower(w).isin("the", "and", "for", "was", "are", "not", "you")
    capital = find_all(c, r"[A-Z](?<!\w.)[A-Za-z]+[0-9]{0,2}(?!\w)")
    first = F.filter(F.array_distinct(F.concat(F.filter(quoted, lambda e: e < "a"), names, F.filter(F.array_distinct(capital), word))), lambda e: F.length(e) >= 2)
    words = F.filter(F.array_distinct(F.split(c, "[^A-Za-z0-9_]+")), word)
    all_ = F.filter(F.array_distinct(F.concat(quoted, names, cjk_topics(c), words)), lambda e: F.length(e) >= 2)
    return F.transform(F.array(first), lambda f: F.slice(F.sort_array(F.when(F.size(f) >= most, f).otherwise(all_)), 1, most))[0]


def trigram_buckets(c: Column) -> Column:
    """The set positions of the hashed trigram vector of the first characters of a text."""
    codes = F.transform(F.split(F.lower(F.substring(c, 1, K.NGRAM_TEXT)), ""), F.ascii)
    after = lambda k: F.slice(codes, k + 1, K.NGRAM_TEXT)
    grams = F.zip_with(F.zip_with(codes, after(1), lambda a, b: a * 31 + b), after(2), lambda ab, d: F.pmod(ab * 31 + d, F.lit(K.NGRAM_DIM)))
    return F.array_distinct(F.filter(grams, lambda g: g.isNotNull()))


def bucket_vector(buckets: Column) -> Column:
    """The hashed trigram vector itself, NGRAM_DIM zeros and ones, from its set positions (a column, so that they are
    computed once)."""
    return F.transform(F.sequence(F.lit(0), F.lit(K.NGRAM_DIM - 1)), lambda k: F.array_contains(buckets, k).cast("float"))


def content_hash(c: Column) -> Column:
    return F.substring(F.md5(c.cast("binary")), 1, 16)


def normal_name(c: Column) -> Column:
    """Lower-cased, without anything but word characters."""
    return F.regexp_replace(F.lower(F.trim(c)), r"(?U)[^\w\x{4e00}-\x{9fff}]", "")


def sentiment(c: Column) -> Column:
    """positive, negative or neutral: a positive word counts 1 for, negated 2 against; a negative word 1 against. Negations
    and most words are of CJK characters, so a text without one is looked through for the other words alone; a negation is
    looked for only before words that are there."""

    def score(positive, negative, negated: bool) -> Column:
        out = F.lit(0)
        for w in positive:
            out = out + F.when(F.contains(c, F.lit(w)), F.when(c.rlike(f"({K.NEGATION})\\s*{w}"), -2).otherwise(1) if negated else F.lit(1)).otherwise(0)
        for w in negative:
            out = out - F.when(F.contains(c, F.lit(w)), 1).otherwise(0)
        return out

    of_ascii = lambda words: [w for w in words if w.isascii()]
    total = F.when(c.rlike(CJK), score(K.POSITIVE, K.NEGATIVE, True)).otherwise(score(of_ascii(K.POSITIVE), of_ascii(K.NEGATIVE), False))
    return F.element_at(F.array(F.lit("negative"), F.lit("neutral"), F.lit("positive")), F.sign(total).cast("int") + 2)


def correction_signals(c: Column) -> Column:
    """The correction signals in the last line's first 300 characters; empty if an ignore pattern vetoes."""
    last = F.substring(F.element_at(F.split(F.lower(F.trim(c)), "\n"), -1), 1, 300)
    hits = F.filter(constant_list(K.CORRECTION_SIGNALS), lambda s: F.contains(last, s))
    veto = F.lit(False)
    for p in K.CORRECTION_IGNORE:
        veto = veto | last.rlike(p)
    return F.when(veto, F.array().cast("array<string>")).otherwise(hits)


def lesson(c: Column) -> Column:
    """The first pattern's capture, as `User: ...`; else the text's first characters."""
    found = [F.nullif(F.regexp_extract(c, "(?i)" + p, 1), F.lit("")) for p in K.LESSON_PATTERNS]
    return F.coalesce(F.concat(F.lit("User: "), F.substring(F.trim(F.coalesce(*found)), 1, 60)), F.substring(F.trim(c), 1, 80))


def profile_values(c: Column) -> Column:
    """Array of (seq, field, value) in pattern order."""
    found = [F.struct(F.lit(i).alias("seq"), F.lit(f).alias("field"), F.trim(F.regexp_extract(c, "(?i)" + p, 1)).alias("value")) for i, (p, f) in enumerate(K.PROFILE_PATTERNS)]
    return F.filter(F.array(*found), lambda x: (x["value"] != "") & ~F.array_contains(constant_list(K.PROFILE_SKIP), F.lower(x["value"])))


def version_parts(c: Column) -> Column:
    """Numbers of a version; arrays compare from the left."""
    return F.transform(F.split(F.regexp_replace(F.trim(c), "^v", ""), r"\."), lambda x: x.cast("int"))


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 4)


def held(c: Column) -> Column:
    """The column as it is, but Spark moves no filter on it below the projection that computes it: a costly expression
    is not computed a second time for the filter."""
    return F.when(F.monotonically_increasing_id() >= 0, c)

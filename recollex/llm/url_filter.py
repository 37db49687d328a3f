"""URL filters: longest-match host and path rules, then logistic regression on hashed character n-grams.

Scoring is one projection over (page_id, url); no shuffle, no Python. The weights are fitted on the driver from the
small labelled table below.
"""

from __future__ import annotations

import math
import random
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollex.llm._shared import ascii_lower

#: The contract's rules.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: The labelled table: hosts that are blocked and hosts that are not, each met with harmless paths, and blocked paths on
#: hosts that are not blocked. General web names and words, and NEUTRAL names made of syllables by a rule.
BLOCKED_HOSTS = (
    "casino-royal casinobonus online-casino best-casinos win-jackpot winbig-slots mega-slots poker-bets sports-bets sure-bet betting-tips "
    "spam-links mailspam link-farm content-farms seo-farming adult-cams xxx-adult hot-adults adults-only adult-chat x-rated sexcams porn-tube "
    "cheap-meds cheap-viagra cheapest-rx pills-online diet-pill pharma-pills ads-network click-ads banner-ads pop-ads ad-tracker click-tracking trackers "
    "free-spins free-iphone free-money freebies-now payday-loans replica-bags warez-crack torrent-zone"
).split()
ALLOWED_HOSTS = (
    "library museum gardening weather university science-news city-council recipes history-notes travel newspaper open-data physics-lab music-school "
    "parents-help health-service cycling astronomy poetry railway language-course public-radio wildlife architecture film-archive station education "
    "translation information northern-lights mothers-union brothers theatre another-day gathering heritage therapist mathematics authors orthopedics "
    "north-shore southern-cross thunder winter-sports window-shop sister-cities london-guide garden-centre sandstone islands handbook hereford "
    "reading-room interior-design tenants shelter nation-states attention fiction other-worlds wing-commander erindale stillwater thornhill anderson"
).split()
PATHS = ("/en/123", "/de/4567.html", "/fr/89/", "/es/31337", "")
BLOCKED_PATHS = (
    "/casino/bonus /online-casino /free-spins /slots/jackpot /poker/bets /betting-tips /xxx/adult /porn/tube /adult-cams /sexcams/live /cheap-viagra /pills/order /diet-pills /spam/links "
    "/link-farm /click-ads /banner-ads /ads/track /free-iphone /free-money /payday-loans /replica-bags /warez/crack /torrent/zone"
).split()
ALLOWED_PATHS = (
    "/about /contact.html /news/elections /archive/2024 /library/catalogue /recipes/bread /history/notes /travel/guide /weather/today /science/physics /music/lessons /health/advice "
    "/maps/region /events/calendar /translation/terms /information /products/list /team/people /research/papers /en/reading /garden/plants /film/reviews /sports/results /jobs/open"
).split()
NEUTRAL = 300
ONSETS, VOWELS, CODAS = "b c d f g h l m n p r s t th st tr br w wh sh ch".split(), "a e i o u ea io ou".split(), "n r s t nd st th sh ng ld ble tion er re".split()
PREFIXES = ("", "www.", "m.", "blog.")
SUFFIXES = (".example.com", ".example.net", ".example.org")

BUCKETS, GRAM, EPOCHS, RATE, DECAY = 1 << 14, 3, 60, 2.0, 1e-4


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for null."""
    return ascii_lower(F.regexp_extract(_rest(url), "^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty without `://` or for null."""
    return F.regexp_extract(F.regexp_replace(_rest(url), "^[^/?#]*", ""), "^[^?#]*", 0)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule_of(host: Column, path: Column, rules) -> Column:
    """The longest (then alphabetically first) rule that fits, as a struct (verdict, rule); null if none. rules is a
    short list of (verdict, 'host/path')."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit("/" + p))
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<verdict:string,rule:string>")


def _grams(part: str, s: str) -> list[int]:
    return [zlib.crc32((part + s[i : i + GRAM]).encode()) % BUCKETS for i in range(len(s) - GRAM + 1)]


def _example(host: str, path: str) -> dict[int, float]:
    x: dict[int, float] = {}
    for part, s in (("h", f"^{host}$"), ("p", f"^{path}$")):
        grams = _grams(part, s)
        for g in grams:
            x[g] = x.get(g, 0.0) + 1 / math.sqrt(len(grams))
    return x


def neutral_names() -> list[str]:
    rng = random.Random(1)
    syllable = lambda: rng.choice(ONSETS) + rng.choice(VOWELS) + (rng.choice(CODAS) if rng.random() < 0.7 else "")
    return ["".join(syllable() for _ in range(rng.randrange(1, 4))) for _ in range(NEUTRAL)]


def labelled_table() -> list[tuple[str, str, int]]:
    """(host, path, blocked): some 1,900 rows."""
    name = lambda h, i, k: PREFIXES[(i + k) % len(PREFIXES)] + h + SUFFIXES[(i + 2 * k) % len(SUFFIXES)]
    neutral, harmless = [*ALLOWED_HOSTS, *neutral_names()], [*PATHS[:4], *ALLOWED_PATHS]
    rows = [(name(h, i, k), path, 1) for i, h in enumerate(BLOCKED_HOSTS) for k, path in enumerate([*PATHS, *ALLOWED_PATHS[::2]])]
    rows += [(name(h, i, k), path, 0) for i, h in enumerate(ALLOWED_HOSTS) for k, path in enumerate(PATHS)]
    rows += [(name(h, i, i), harmless[(5 * i + k) % len(harmless)], 0) for i, h in enumerate(neutral) for k in range(2)]
    return rows + [(name(neutral[(7 * i + 5 * k) % len(neutral)], i, k), path, 1) for i, path in enumerate(BLOCKED_PATHS) for k in range(2)]


def fit(table=None) -> tuple[list[float], float]:
    """Weights and bias from a labelled table of (host, path, blocked); by default the built-in one. The same table
    always gives the same weights."""
    table = labelled_table() if table is None else table
    rows = [(_example(h, p), y) for h, p, y in table]
    w, b = [0.0] * BUCKETS, 0.0
    for epoch in range(EPOCHS):
        rate = RATE / (1 + 0.1 * epoch)
        for k in range(len(rows)):
            x, y = rows[(k * 7919 + epoch) % len(rows)]
            e = 1 / (1 + math.exp(-b - sum(w[g] * v for g, v in x.items()))) - y
            b -= 0.1 * rate * e
            for g, v in x.items():
                w[g] -= rate * (e * v + DECAY * w[g])
    return [round(v, 6) for v in w], round(b, 6)


def block_probability(host: Column, path: Column, weights: list[float], bias: float) -> Column:
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<double>")  # folded to one constant

    def total(part: str, s: Column) -> Column:
        grams = F.regexp_extract_all(F.concat(F.lit("^"), s, F.lit("$")), F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1))
        add = lambda a, g: a + F.get(table, F.pmod(F.crc32(F.concat(F.lit(part), g).cast("binary")), F.lit(BUCKETS)).cast("int"))
        return F.when(F.size(grams) > 0, F.aggregate(grams, F.lit(0.0), add) / F.sqrt(F.size(grams))).otherwise(0.0)

    return 1 / (1 + F.exp(-(F.lit(bias) + total("h", host) + total("p", path))))


def judge_urls(pages: DataFrame, rules=RULES, model: tuple[list[float], float] | None = None, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row of pages (page_id, url).

    verdict is the longest fitting rule's, else block if score (the regression's probability) reaches threshold, else
    allow. Null urls and urls without `://` have empty host and path, fit no rule and are allowed or blocked by the
    regression like any other. Repeated rows are judged alike; long urls are read whole; an empty table gives none.
    """
    weights, bias = model or fit()
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    scored = parts.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).withColumn("score", block_probability(F.col("host"), F.col("path"), weights, bias))
    return scored.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))

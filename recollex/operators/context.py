"""Context budgets, session bridges, knowledge files, integrity and provider sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollex import consts as K
from recollex.functions import text

# ---- context budgets


def level(total: Column, budget: int = K.BUDGET_CHARS) -> Column:
    """over, auto, mild, warn or ok by the share of the budget."""
    r = total / budget
    return F.when(r >= 1, "over").when(r >= K.AUTO, "auto").when(r >= K.MILD, "mild").when(r >= K.WARN, "warn").otherwise("ok")


def payload_levels(sections: DataFrame, budget: int = K.BUDGET_CHARS) -> DataFrame:
    """payload_id, total, tokens, pct, level of sections (payload_id, content)."""
    t = sections.groupBy("payload_id").agg(F.sum(F.length("content")).cast("long").alias("total"))
    return t.select("payload_id", "total", F.floor(F.col("total") / 4).alias("tokens"), F.bround(F.least(F.col("total") * 100.0 / budget, F.lit(100.0)), 1).alias("pct"), level(F.col("total"), budget).alias("level"))


#: Fixed value: what stands at the end of a cut section, around its name.
REF_HEAD, REF_TAIL = "… [↩ ref:", "]"


def _planned(sections: DataFrame, budget: int, mild: float, auto: float) -> DataFrame:
    """sections with place (their order in the prompt), n (characters), action, cut (characters kept of a cut section) and
    kept (characters with the mark). Each loop of the two tiers is a running sum: a section is admitted while what stands
    before it fits, and once one doesn't fit none after it does; cuts stop at the first section that the total before it
    is within the limit. So one shuffle of the payloads' sections, no task state beyond a window's."""
    names = F.col("name") if "name" in sections.columns else F.lit(None).cast("string")
    s = sections.select(
        "payload_id", "seq", F.coalesce(names, F.col("seq").cast("string"), F.lit("")).alias("name"), F.coalesce("content", F.lit("")).alias("content"),
        F.coalesce("priority", F.lit(5)).alias("p"), (F.coalesce("category", F.lit("memory")) == "memory").alias("memory"),
    ).withColumn("n", F.length("content").cast("long"))
    payload = Window.partitionBy("payload_id")
    order = payload.orderBy("p", "seq", "name", "n")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    mark = F.length("name") + len(REF_HEAD) + len(REF_TAIL)
    most = lambda share, cap: F.least(F.floor(F.col("n") * F.lit(share)), F.lit(cap)).cast("long")

    def ahead(c: Column) -> Column:
        return F.coalesce(F.sum(c).over(before), F.lit(0))

    def cuts(s: DataFrame, able: Column, to: str, stays: str, limit: int, name: str) -> DataFrame:
        """name: whether a section that can be cut is, before the total is within the limit."""
        s = s.withColumn("able", able).withColumn("saves", F.when(F.col("able"), F.col("n") - F.col(to) - mark).otherwise(0))
        s = s.withColumn("left", F.sum(F.when(F.col(stays), F.col("n")).otherwise(0)).over(payload) - ahead(F.col("saves")))
        return s.withColumn(name, F.col("able") & ~F.max(F.col("left") <= limit).over(order.rowsBetween(Window.unboundedPreceding, 0)))

    s = s.withColumns({"m1": most(K.MILD_KEEP, K.MILD_CAP), "m2": most(K.HARD_KEEP, K.HARD_CAP), "first": F.sum("n").over(payload) > int(budget * mild)})
    s = s.withColumn("in1", ~F.col("first") | (F.col("p") < 9) | (ahead(F.col("n")) <= budget))
    s = cuts(s, F.col("first") & F.col("in1") & F.col("memory") & (F.col("p") >= 5) & (F.col("n") > F.col("m1")), "m1", "in1", int(budget * mild), "cut1")
    s = s.withColumn("size", F.when(F.col("cut1"), F.col("m1") + mark).otherwise(F.col("n")))
    s = s.withColumn("second", F.col("first") & (F.sum(F.when(F.col("in1"), F.col("size")).otherwise(0)).over(payload) > int(budget * auto)))
    s = s.withColumn("in2", F.col("in1") & (~F.col("second") | (F.col("p") < 7) | (ahead(F.when(F.col("in1"), F.col("n")).otherwise(0)) <= budget)))
    s = cuts(s, F.col("second") & F.col("in2") & F.col("memory") & (F.col("size") > F.col("m2")), "m2", "in2", budget, "cut2")
    action = F.when(~F.col("in1"), "deferred").when(~F.col("in2"), "demoted").when(F.col("cut2"), "truncated_aggressive").when(F.col("cut1"), "truncated").otherwise("keep")
    s = s.withColumn("action", action).withColumn("cut", F.when(~F.col("in2"), F.lit(0)).when(F.col("cut2"), F.col("m2")).when(F.col("cut1"), F.col("m1")))
    kept = F.when(~F.col("in2"), F.lit(0)).otherwise(F.coalesce(F.col("cut") + mark, F.col("n"))).cast("long")
    place = F.struct(F.when(F.col("first"), F.col("p")).alias("p"), "seq", "name", "n")
    return s.select("payload_id", "seq", "name", "content", "n", "action", "cut", kept.alias("kept"), place.alias("place"))


def compress(sections: DataFrame, budget: int = K.BUDGET_CHARS, mild: float = K.MILD, auto: float = K.AUTO) -> DataFrame:
    """payload_id, seq, action, kept: sections (payload_id, seq, content, priority, category, perhaps name) under a budget.

    In order of priority (ties by seq). Over the mild limit, sections of priority 9 and more are deferred once what stands
    before them is over the budget, and memory sections of priority 5 and more are cut, to the lesser of a share and a cap,
    until the total fits. If it is still over the auto limit, the same is done to priority 7 and more, and memory of any
    priority is cut harder, until the budget is met; sizes count as they were before the first cuts. A cut section ends in
    a mark with its name, so cutting a short one can make it longer. Null content is empty, a null priority 5, a null
    category memory, a null name the seq; payloads that fit keep all."""
    return _planned(sections, budget, mild, auto).select("payload_id", "seq", "action", "kept")


def injection(sections: DataFrame, budget: int = K.BUDGET_CHARS, mild: float = K.MILD, auto: float = K.AUTO) -> DataFrame:
    """payload_id, text, injected, pct, sections, saved, actions: the prompt of each payload after compression, blank
    sections left out, with its report. injected and pct count what stays by its size before cutting; saved is what the
    actions took off. A payload without any section that stays has an empty text."""
    s = _planned(sections, budget, mild, auto)
    stays = ~F.col("action").isin("deferred", "demoted")
    part = F.when(F.col("cut").isNull(), F.col("content")).otherwise(F.concat(F.expr("left(content, cast(cut AS int))"), F.lit(REF_HEAD), "name", F.lit(REF_TAIL)))
    part = F.when(stays & part.rlike(r"\S"), F.struct("place", part.alias("part")))
    g = s.groupBy("payload_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["part"]), "\n\n").alias("text"),
        F.sum(F.when(stays, F.col("n")).otherwise(0)).alias("injected"), F.count_if(stays).alias("sections"),
        F.sum(F.col("n") - F.col("kept")).alias("saved"), F.count_if(F.col("action") != "keep").alias("actions"),
    )
    return g.withColumn("pct", F.bround(F.least(F.col("injected") * 100.0 / budget, F.lit(100.0)), 1))


def cut_originals(sections: DataFrame, budget: int = K.BUDGET_CHARS, mild: float = K.MILD, auto: float = K.AUTO) -> DataFrame:
    """payload_id, name, content: the whole texts of the sections that were cut, for `sinks.save_refs`; the marks name them."""
    s = _planned(sections, budget, mild, auto)
    return s.where(F.col("action").isin("truncated", "truncated_aggressive")).select("payload_id", "name", "content")


def running_truncation(sections: DataFrame, limit: int, keep: float, cap: int) -> DataFrame:
    """payload_id, seq, cut_to: sections in order of (priority, seq) are cut while the total without what earlier cuts
    saved is over the limit, to the lesser of a share and a cap; a running sum instead of a loop."""
    cut = F.least(F.lit(cap), F.floor(F.length("content") * keep)).cast("long")
    s = sections.withColumn("n", F.length("content").cast("long")).withColumn("saved", F.greatest(F.col("n") - cut, F.lit(0)))
    order = Window.partitionBy("payload_id").orderBy("priority", "seq")
    s = s.withColumn("total", F.sum("n").over(Window.partitionBy("payload_id"))).withColumn("before", F.coalesce(F.sum("saved").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return s.select("payload_id", "seq", F.when((F.col("total") - F.col("before") > limit) & (F.col("saved") > 0), F.col("n") - F.col("saved")).otherwise(F.col("n")).alias("cut_to"))


# ---- session bridge


def last_rounds(turns: DataFrame, n: int = K.RING["rounds"]) -> DataFrame:
    """session_id, place, user, assistant: the newest n rounds (a user turn and the assistant's answer after it)."""
    w = Window.partitionBy("session_id").orderBy("turn")
    r = turns.withColumn("assistant", F.when(F.lead("role").over(w) == "assistant", F.lead("text").over(w))).where("role = 'user'")
    r = r.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("turn"))))
    return r.where(F.col("place") <= n).select("session_id", "place", F.col("text").alias("user"), "assistant")


def prefill(turns: DataFrame, rejected: DataFrame) -> DataFrame:
    """session_id, messages (JSON): a system line and the last rounds in order, without rounds that the gate rejects
    (session_id, place)."""
    r = last_rounds(turns).join(rejected, ["session_id", "place"], "left_anti")
    msg = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    each = r.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("place")).alias("o"), F.filter(F.array(msg("user", "user"), msg("assistant", "assistant")), lambda m: m["content"].isNotNull()).alias("m")))).alias("rows"))
    return each.select("session_id", F.to_json(F.flatten(F.transform("rows", lambda x: x["m"]))).alias("messages"))


# ---- texts for a prompt


def working_memory_text(todos: DataFrame, contexts: DataFrame) -> DataFrame:
    """session_id, text: the task, the newest contexts and the open to-dos of a session as Markdown. todos: session_id, id,
    todo, done; contexts: session_id, place, at, text (few a session)."""
    t = todos.groupBy("session_id").agg(F.array_sort(F.collect_list(F.when(~F.col("done"), F.struct("id", "todo")))).alias("todos"), F.min_by("todo", "id").alias("task"))
    c = contexts.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("place", "at", "text"))).alias("contexts"))
    lines = F.concat(
        F.array(F.concat(F.lit("**Task:** "), F.substring("task", 1, 60))),
        F.transform(F.coalesce("contexts", F.array().cast("array<struct<place:long,at:string,text:string>>")), lambda x: F.concat(F.lit("- ["), x["at"], F.lit("] "), x["text"])),
        F.transform("todos", lambda x: F.concat(F.lit("- [ ] "), x["todo"])),
    )
    return t.join(c, "session_id", "left").select("session_id", F.array_join(lines, "\n").alias("text"))


def bridge_text(rounds: DataFrame, topics: DataFrame) -> DataFrame:
    """session_id, summary: a session's topic and its last rounds (session_id, place, user, assistant), oldest first, both
    sides cut to 80 characters."""
    head = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "))
    said = F.concat(head, F.lit("user: "), F.substring("user", 1, 80), F.coalesce(F.concat(F.lit("\n"), head, F.lit("assistant: "), F.substring("assistant", 1, 80)), F.lit("")))
    r = rounds.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("place")).alias("o"), said.alias("s")))).alias("r"))
    return r.join(topics, "session_id").select("session_id", F.concat(F.lit("Topic: "), "topic", F.lit("\n"), F.array_join(F.transform("r", lambda x: x["s"]), "\n")).alias("summary"))


def warning(provider: Column, pct: Column, deep: Column, lang: Column, warn: float = K.WARN) -> Column:
    """A provider's warning in English or Chinese (zh); empty below the line."""
    line = int(warn * 100)
    at = F.concat(F.when(lang == "zh", F.concat(provider, F.lit("上下文 "))).otherwise(F.concat(provider, F.lit(" context at "))), pct.cast("string"), F.lit("%"))
    zh = lang == "zh"
    return (
        F.when(deep, F.concat(at, F.when(zh, "，对话已深").otherwise(", deeply compressed")))
        .when(pct >= line, F.concat(at, F.when(zh, f"，接近 {line}% 预警线").otherwise(f", near the {line}% line")))
        .otherwise("")
    )


def report_message(events: DataFrame) -> DataFrame:
    """key, message of each key's newest compression (key, event_id, before, after), unless it was reported already
    (reported: the event last reported) or saved nothing."""
    last = events.groupBy("key").agg(F.max_by(F.struct("event_id", "before", "after"), "event_id").alias("e"), F.max("reported").alias("reported"))
    saved = F.col("e.before") - F.col("e.after")
    fresh = last.where((saved > 0) & (F.col("reported").isNull() | (F.col("reported") != F.col("e.event_id"))))
    left = F.bround(F.col("e.after") * 100.0 / F.col("e.before"), 1)
    return fresh.select("key", F.concat(F.lit("saved ~"), F.floor(saved / 4).cast("string"), F.lit(" tokens ("), left.cast("string"), F.lit("% left)")).alias("message"))


# ---- knowledge files


def html_keywords(c: Column) -> Column:
    """Distinct lower-cased words of headings, bold text and the first three words of list items."""
    parts = F.concat(text.find_all(c, "(?s)<h[1-4][^>]*>(.*?)</h[1-4]>", 1), text.find_all(c, "(?s)<b>(.*?)</b>", 1), F.transform(text.find_all(c, "(?s)<li>(.*?)</li>", 1), lambda x: F.array_join(F.slice(F.split(F.trim(F.regexp_replace(x, "<[^>]*>", "")), r"\s+"), 1, 3), " ")))
    return F.array_distinct(F.flatten(F.transform(parts, lambda p: text.query_words(F.regexp_replace(p, "<[^>]*>", " "), 3))))


def kb_scores(files: DataFrame, query: str, most: int = K.KB_TOP) -> DataFrame:
    """file_id, score of the best files (file_id, filename, triggers): 10 for each query word that is a trigger, 5 for one
    that is part of a trigger or holds one, 3 for one in the filename."""
    words = F.array_distinct(text.query_words(F.lit(query)))

    def points(w: Column) -> Column:
        near = F.exists("triggers", lambda t: F.contains(t, w) | F.contains(w, t))
        return F.when(F.array_contains("triggers", w), K.KB_EXACT).when(near, K.KB_PARTIAL).otherwise(0) + F.when(F.contains(F.lower("filename"), w), K.KB_FILENAME).otherwise(0)

    s = files.select("file_id", F.aggregate(F.transform(words, points), F.lit(0), lambda a, b: a + b).alias("score"))
    return s.where("score > 0").orderBy(F.desc("score"), "file_id").limit(most)


# ---- integrity


def integrity_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """path, status of a manifest (path, sha256) against an inventory: ok, changed, missing or unknown."""
    e, a = expected.withColumnRenamed("sha256", "want"), actual.withColumnRenamed("sha256", "have")
    j = e.join(a, "path", "full_outer")
    return j.select("path", F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unknown").when(F.col("want") == F.col("have"), "ok").otherwise("changed").alias("status"))


def integrity_verdicts(expected: DataFrame, actual: DataFrame, data_files: list[str], backups: DataFrame) -> DataFrame:
    """path, status, recover_from of a manifest (path, sha256) against an inventory: ok, missing, data_changed (a file that
    is meant to change) or tampered; for tampered files the newest backup (path, day, copy)."""
    newest = backups.groupBy("path").agg(F.max_by("copy", "day").alias("copy"))
    j = expected.withColumnRenamed("sha256", "want").join(actual.withColumnRenamed("sha256", "have"), "path", "left").join(newest, "path", "left")
    status = F.when(F.col("have").isNull(), "missing").when(F.col("want") == F.col("have"), "ok").when(F.col("path").isin(*data_files), "data_changed").otherwise("tampered")
    return j.withColumn("status", status).select("path", "status", F.when(F.col("status") == "tampered", F.col("copy")).alias("recover_from"))


def alerts(verdicts: DataFrame, lines: int = 20) -> DataFrame:
    """title, body of an alert on what is missing or tampered; no row if all is well. The body has the first lines."""
    bad = verdicts.where(F.col("status").isin("missing", "tampered"))
    n = bad.agg(F.count("*").alias("n"))
    first = bad.orderBy("path").limit(lines).agg(F.array_join(F.array_sort(F.collect_list(F.concat("path", F.lit(": "), "status"))), "\n").alias("body"))
    return n.crossJoin(first).where("n > 0").select(F.concat(F.lit("integrity: "), F.col("n").cast("string"), F.lit(" critical")).alias("title"), "body")


def forensic_deltas(current: DataFrame, backup: DataFrame, limit: int = 500) -> DataFrame:
    """path, delta, finding of files (path, content) against their backup: grown or shrunk by more than limit bytes, and
    whether the content is JSON."""
    j = current.join(backup.select("path", F.octet_length("content").alias("was")), "path")
    delta = (F.octet_length("content") - F.col("was")).cast("long")
    finding = F.when(delta > limit, "possible injection").when(delta < -limit, "possible deletion").otherwise("none")
    return j.select("path", delta.alias("delta"), finding.alias("finding"), F.try_parse_json("content").isNotNull().alias("json"))


def user_partition(rows: DataFrame, base: str, user: str = "user_id") -> DataFrame:
    """rows with path, the folder of their user (base/user); rows without a user are the user `default`'s."""
    name = F.coalesce(F.nullif(F.trim(F.col(user).cast("string")), F.lit("")), F.lit("default"))
    return rows.withColumn("path", F.concat(F.lit(base + "/"), name))


def of_user(rows: DataFrame, user_id) -> DataFrame:
    """The rows of one user; there is no way to read without naming one."""
    if user_id is None or not str(user_id).strip():
        raise ValueError("name a user")
    return rows.where(F.col("user_id") == user_id)


def unescaped(c: Column) -> Column:
    """JSON text with its \\u escapes replaced by the characters; text that is no JSON stays."""
    return F.coalesce(F.to_json(F.try_parse_json(c)), c)


def bounded_log(rows: DataFrame, order: list[Column], n: int, key: str | None = None) -> DataFrame:
    """The newest n rows, or the newest n of each key; over the whole log a limit under the sort, not a window."""
    if key is None:
        return rows.orderBy(*order).limit(n)
    return rows.withColumn("__place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__place") <= n).drop("__place")


def retained_days(rows: DataFrame, ts: str = "ts", days: int = 3) -> DataFrame:
    """Rows of the newest distinct days: the days are ranked, not the rows."""
    d = rows.select(F.to_date(ts).alias("d")).distinct().orderBy(F.desc("d")).limit(days)
    return rows.withColumn("d", F.to_date(ts)).join(F.broadcast(d), "d", "left_semi").drop("d")


# ---- providers


def latest_session(sessions: DataFrame, limit_tokens: int) -> DataFrame:
    """provider, session_id, tokens, calls, pct, compressed of each provider's newest session."""
    s = sessions.groupBy("provider").agg(F.max_by(F.struct("session_id", "input_tokens", "api_calls"), F.struct("started_at", "session_id")).alias("s"))
    pct = F.least(F.lit(100), F.bround(F.col("s.input_tokens") * 100.0 / limit_tokens).cast("int"))
    return s.select("provider", "s.session_id", F.col("s.input_tokens").alias("tokens"), F.col("s.api_calls").alias("calls"), pct.alias("pct"), ((F.col("s.api_calls") > 20) & (pct < 30)).alias("compressed"))


def resolve(sessions: DataFrame, priority: list[str], forced: str | None = None) -> DataFrame:
    """provider, n of the first provider by priority that has sessions; a forced one (set from outside) wins if it has."""
    order = ([forced] if forced else []) + [p for p in priority if p != forced]
    rank = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in order]), F.col("provider")), F.lit(0))
    n = sessions.groupBy("provider").agg(F.count("*").alias("n"))
    return n.orderBy(F.when(rank > 0, rank).otherwise(len(order) + 1), "provider").limit(1)


def json_sessions(files: DataFrame, context: int = 128_000) -> DataFrame:
    """session_id, calls, tokens, pct, compressed of session files (session_id, content): JSON with a list of messages
    (or history); fewer than two say nothing."""
    j = F.from_json("content", "struct<messages:array<struct<role:string>>,history:array<struct<role:string>>>")
    calls = F.size(F.coalesce(j["messages"], j["history"]))
    s = files.select("session_id", calls.alias("calls")).where("calls >= 2").withColumn("tokens", F.col("calls") * 1000)
    return s.select("session_id", "calls", "tokens", F.least(F.lit(100), F.bround(F.col("tokens") * 100.0 / context).cast("int")).alias("pct"), ((F.col("calls") > 40) | (F.col("tokens") > context)).alias("compressed"))


def tail_tokens(rows: DataFrame, n: int = 20) -> DataFrame:
    """provider, tokens, calls over the last n rows of each provider (provider, seq, tokens); null tokens count nothing."""
    t = rows.withColumn("p", F.row_number().over(Window.partitionBy("provider").orderBy(F.desc("seq")))).where(F.col("p") <= n)
    return t.groupBy("provider").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.count_if(F.col("tokens") > 0).alias("calls"))

"""Projections, filters and predicates (narrow: no shuffle unless a query aggregates the outcome)."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.expr import hash_rank, hash_rank_sql
from weft.registry import query
from weft.sources.tables import table


def map_values(value: Column, mapping: Mapping[str, str], unknown: str | None = "keep") -> Column:
    """Renames values; unknown ones pass through (``keep``) or become null (None)."""
    names = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    found = F.try_element_at(names, value)
    return F.coalesce(found, value) if unknown == "keep" else found


def composite_key(*parts: str) -> Column:
    return F.concat_ws("|", *[F.col(p).cast("string") for p in parts])


def render_token(domain: Column, codes: Sequence[Column]) -> Column:
    """An item token: ``<|domain_begin|><a_1><b_2><c_3>``."""
    named = [F.concat(F.lit(f"<{name}_"), code.cast("string"), F.lit(">")) for name, code in zip("abc", codes, strict=True)]
    return F.concat(F.lit("<|"), domain, F.lit("_begin|>"), *named)


CODE_BITS = 13


def pack(domain: Column, a: Column, b: Column, c: Column) -> Column:
    """A domain number and three codes below 2^13 in one long; null where a code is out of range."""
    fits = [x.between(0, (1 << CODE_BITS) - 1) for x in (a, b, c)]
    packed = F.shiftleft(domain.cast("long"), 3 * CODE_BITS)
    for i, x in enumerate((a, b, c)):
        packed = packed.bitwiseOR(F.shiftleft(x.cast("long"), CODE_BITS * (2 - i)))
    return F.when(fits[0] & fits[1] & fits[2], packed)


def unpack(packed: Column) -> list[Column]:
    mask = F.lit((1 << CODE_BITS) - 1)
    return [F.shiftright(packed, 3 * CODE_BITS), *[F.shiftright(packed, CODE_BITS * (2 - i)).bitwiseAND(mask) for i in range(3)]]


def flag(value: Column) -> Column:
    """True if the value is a number above 0, else false."""
    return F.coalesce(value.try_cast("double") > 0, F.lit(False))


def digits_as_time(value: Column) -> Column:
    """The digits of a text, padded to 14, as an integer; null without digits."""
    digits = F.regexp_replace(value.cast("string"), "[^0-9]", "")
    return F.when(digits != "", F.rpad(digits, 14, "0").try_cast("long"))


def first_rule(rules: Sequence[tuple[str, Column]], otherwise: str = "other") -> Column:
    """The label of the first rule that holds."""
    out = F.lit(otherwise)
    for label, holds in reversed(rules):
        out = F.when(holds, F.lit(label)).otherwise(out)
    return out


def reasons(rules: Sequence[tuple[str, Column]]) -> Column:
    """Codes of all the rules that hold, in order: a row passes if there is none."""
    return F.array_compact(F.array(*[F.when(holds, F.lit(code)) for code, holds in rules]))


#: Keyword families of the policy filter (fixed values).
POLICY = {
    "identity": "(?i)(your name|who are you|i am an assistant)",
    "injection": "(?i)(ignore (all|previous)|system prompt)",
    "time_sensitive": "(?i)(today|latest|currently)",
    "high_risk": "(?i)(diagnos|lawsuit|invest)",
    "subjective": "(?i)(in my opinion|i think|best ever)",
    "media": "(?i)(image|video|audio)",
}


def policy_flags(text: Column, families: Mapping[str, str] = POLICY) -> Column:
    return reasons([(name, text.rlike(pattern)) for name, pattern in families.items()])


_CONDITIONS = (
    (re.compile(r"^domain is ([a-z]+)$"), lambda m: F.col("domain") == m[1]),
    (re.compile(r"^action is ([a-z]+)$"), lambda m: F.col("action") == m[1]),
    (re.compile(r"^text contains '([^']*)'$"), lambda m: F.col("text").contains(m[1])),
    (re.compile(r"^date from (\d{4}-\d\d-\d\d) to (\d{4}-\d\d-\d\d)$"), lambda m: F.to_date("ts").between(m[1], m[2])),
    (re.compile(r"^month is (\d{4}-\d\d)$"), lambda m: F.date_format("ts", "yyyy-MM") == m[1]),
    (re.compile(r"^year is (\d{4})$"), lambda m: F.year("ts") == int(m[1])),
)


def condition(text: str) -> Column:
    """The predicate that a condition names; clauses are joined by `` and ``."""
    out = None
    for clause in text.split(" and "):
        part = next((make(m) for pattern, make in _CONDITIONS if (m := pattern.match(clause))), None)
        if part is None:
            raise ValueError(f"no such condition: {clause!r}")
        out = part if out is None else out & part
    return out


def condition_text(**parts: str) -> str:
    """The condition with these parts: domain, action, contains, start and end, month, year."""
    forms = {"domain": "domain is {}", "action": "action is {}", "contains": "text contains '{}'", "month": "month is {}", "year": "year is {}"}
    clauses = [forms[k].format(v) for k, v in parts.items() if k in forms]
    if "start" in parts:
        clauses.append(f"date from {parts['start']} to {parts['end']}")
    return " and ".join(clauses)


def strongest(rules: Sequence[tuple[Column, int]]) -> Column:
    """The highest strength of the conditions that hold, 0 if none does."""
    return F.greatest(F.lit(0), F.lit(0), *[F.when(holds, F.lit(s)).otherwise(F.lit(0)) for holds, s in rules])


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One row per invariant: how many rows break it (a null outcome breaks it)."""
    broken = df.agg(*[F.sum(F.when(holds, 0).otherwise(1)).alias(name) for name, holds in rules.items()])
    return broken.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(n, F.lit(0)).alias("n")) for n in rules])).alias("r")).select("r.*")


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a user timeline: domain, action, item key, text."""
    events = table(spark, sf_dir, "events")
    domain = F.element_at(F.array(*[F.lit(x) for x in ("video", "ad", "goods", "live")]), (F.col("event_id") % 4 + 1).cast("int"))
    return events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), domain.alias("domain"), F.col("event_type").alias("action"), F.get_json_object("props", "$.k").cast("long").alias("item"), "value", F.col("props").alias("text"))


#: ``timeline`` in SQL.
TIMELINE = """SELECT user_id, event_id, ts, ['video', 'ad', 'goods', 'live'][event_id % 4 + 1] AS domain, event_type AS action, (props::JSON->>'k')::BIGINT AS item, value, props AS text FROM events"""


@query("map_domain", "SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'eco' WHEN 'SMALL' THEN 'sml' ELSE p_type END AS domain, CASE p_type WHEN 'ECONOMY' THEN 'eco' WHEN 'SMALL' THEN 'sml' END AS known FROM part")
def map_domain(spark, sf_dir):
    names = {"ECONOMY": "eco", "SMALL": "sml"}
    return table(spark, sf_dir, "part").select("p_partkey", map_values(F.col("p_type"), names).alias("domain"), map_values(F.col("p_type"), names, None).alias("known"))


@query("composite_key", "SELECT p_type || '|' || p_partkey AS key, p_size FROM part")
def composite_key_query(spark, sf_dir):
    return table(spark, sf_dir, "part").select(composite_key("p_type", "p_partkey").alias("key"), "p_size")


@query("render_token", "SELECT p_partkey, '<|' || lower(p_type) || '_begin|><a_' || replace(p_brand, 'Brand#', '') || '><b_' || p_size || '><c_' || p_partkey % 8 || '>' AS token FROM part")
def render_token_query(spark, sf_dir):
    codes = [F.regexp_extract("p_brand", "([0-9]+)", 1), F.col("p_size"), F.col("p_partkey") % 8]
    return table(spark, sf_dir, "part").select("p_partkey", render_token(F.lower("p_type"), codes).alias("token"))


@query(
    "pack_bits",
    """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey <= 8191 THEN ((p_partkey % 4) << 39) | (regexp_extract(p_brand, '([0-9]+)', 1)::BIGINT << 26) | (p_size::BIGINT << 13) | p_partkey END AS packed FROM part)
       SELECT p_partkey, packed, packed >> 39 AS d, (packed >> 26) & 8191 AS a, (packed >> 13) & 8191 AS b, packed & 8191 AS c FROM p""",
)
def pack_bits(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    packed = pack(F.col("p_partkey") % 4, F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long"), F.col("p_size"), F.col("p_partkey"))
    out = part.select("p_partkey", packed.alias("packed"))
    return out.select("*", *[x.alias(n) for n, x in zip("dabc", unpack(F.col("packed")), strict=True)])


@query(
    "safe_cast",
    """SELECT event_id, coalesce(TRY_CAST(CASE WHEN event_id % 3 = 0 THEN event_type ELSE value::VARCHAR END AS DOUBLE) > 0, false) AS is_on,
       rpad(strftime(ts, '%Y%m%d'), 14, '0')::BIGINT AS day_time, TRY_CAST(event_type AS BIGINT) AS no_number FROM events""",
)
def safe_cast(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    mixed = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("value").cast("string"))
    return events.select("event_id", flag(mixed).alias("is_on"), digits_as_time(F.date_format("ts", "yyyy-MM-dd")).alias("day_time"), F.col("event_type").try_cast("long").alias("no_number"))


@query(
    "case_classify",
    r"""SELECT doc_id, CASE WHEN regexp_matches(text, '^\s*\[') THEN 'json_array' WHEN regexp_matches(text, '(?i)licen[cs]e') THEN 'license' WHEN regexp_matches(text, '[0-9]{3}') THEN 'numeric' WHEN length(text) < 400 THEN 'short' ELSE 'prose' END AS task FROM documents""",
)
def case_classify(spark, sf_dir):
    text = F.col("text")
    rules = [("json_array", text.rlike(r"^\s*\[")), ("license", text.rlike("(?i)licen[cs]e")), ("numeric", text.rlike("[0-9]{3}")), ("short", F.length(text) < 400)]
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", first_rule(rules, "prose").alias("task"))


def caption_type(text: Column) -> Column:
    """null / empty / short (below 10 characters) / list (bracketed, quoted, with commas) / prose."""
    return F.when(text.isNull(), "null").otherwise(first_rule([("empty", F.trim(text) == ""), ("short", F.length(text) < 10), ("list", text.rlike(r"^\[.*['\"].*,.*\]$"))], "prose"))


@query(
    "caption_type",
    r"""WITH c AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 7 = 1 THEN ' ' WHEN p_partkey % 7 = 2 THEN '[''' || p_name || ''', ''x'']' ELSE p_name END AS c FROM part)
        SELECT p_partkey, CASE WHEN c IS NULL THEN 'null' WHEN trim(c) = '' THEN 'empty' WHEN length(c) < 10 THEN 'short' WHEN regexp_matches(c, '^\[.*[''"].*,.*\]$') THEN 'list' ELSE 'prose' END AS kind FROM c""",
)
def caption_type_query(spark, sf_dir):
    m = F.col("p_partkey") % 7
    caption = F.when(m == 0, F.lit(None)).when(m == 1, " ").when(m == 2, F.concat(F.lit("['"), F.col("p_name"), F.lit("', 'x']"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", caption_type(caption).alias("kind"))


_REJECT = "list_filter([CASE WHEN n_chars < 200 THEN 'too_short' END, CASE WHEN n_chars > 5000 THEN 'too_long' END, CASE WHEN lang <> 'en' THEN 'not_english' END, CASE WHEN regexp_matches(text, '[0-9]{5}') THEN 'digits' END], lambda x: x IS NOT NULL)"


def document_reasons() -> Column:
    return reasons([("too_short", F.col("n_chars") < 200), ("too_long", F.col("n_chars") > 5000), ("not_english", F.col("lang") != "en"), ("digits", F.col("text").rlike("[0-9]{5}"))])


@query("reject_reasons", f"SELECT doc_id, {_REJECT} AS reasons, len({_REJECT}) = 0 AS passed FROM documents")
def reject_reasons(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "n_chars")
    return docs.withColumn("reasons", document_reasons()).select("doc_id", "reasons", (F.size("reasons") == 0).alias("passed"))


@query("reason_hist", f"SELECT unnest({_REJECT}) AS reason, count(*) AS n FROM documents GROUP BY 1")
def reason_hist(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "text", "lang", "n_chars")
    return docs.select(F.explode(document_reasons()).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


_POLICY_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in POLICY.items()) + "], lambda x: x IS NOT NULL)"


@query("policy_flags", f"SELECT conv_id, turn, {_POLICY_SQL.replace('text,', 'role || chr(32) || text,')} AS flags FROM conversations")
def policy_flags_query(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", policy_flags(F.concat_ws(" ", "role", "text")).alias("flags"))


@query("ts_valid_range", "SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events WHERE epoch_us(ts) // 1000 BETWEEN 1704412800000 AND 1705276800000")
def ts_valid_range(spark, sf_dir):
    events = table(spark, sf_dir, "events", "event_id", "ts").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return events.filter(F.col("ms").between(1704412800000, 1705276800000))


@query("cond_domain", f"SELECT event_id FROM ({TIMELINE}) WHERE domain = 'goods'")
def cond_domain(spark, sf_dir):
    return timeline(spark, sf_dir).filter(condition(condition_text(domain="goods"))).select("event_id")


@query("cond_month", f"SELECT event_id FROM ({TIMELINE}) WHERE domain = 'video' AND strftime(ts, '%Y-%m') = '2024-01'")
def cond_month(spark, sf_dir):
    return timeline(spark, sf_dir).filter(condition(condition_text(domain="video", month="2024-01"))).select("event_id")


@query("cond_action_range", f"SELECT event_id FROM ({TIMELINE}) WHERE action = 'purchase' AND ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'")
def cond_action_range(spark, sf_dir):
    return timeline(spark, sf_dir).filter(condition(condition_text(action="purchase", start="2024-01-05", end="2024-01-12"))).select("event_id")


@query(
    "cond_accept",
    f"""SELECT user_id, action, count(*) AS matches, count(DISTINCT item) AS gold, any_value(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM ({TIMELINE}))
        GROUP BY user_id, action HAVING count(*) >= 1 AND count(*) <= 0.9 * any_value(n) AND count(DISTINCT item) <= 45""",
)
def cond_accept(spark, sf_dir):
    """Conditions that match some but not nearly all of a user's events, with a bounded answer."""
    events = timeline(spark, sf_dir)
    per = events.groupBy("user_id", "action").agg(F.count("*").alias("matches"), F.countDistinct("item").alias("gold"))
    sizes = per.groupBy("user_id").agg(F.sum("matches").alias("n"))
    return per.join(sizes, "user_id").filter((F.col("matches") >= 1) & (F.col("matches") <= 0.9 * F.col("n")) & (F.col("gold") <= 45)).select("user_id", "action", "matches", "gold", "n")


def flag_label(flags: Sequence[tuple[str, Column]], tail: Column) -> Column:
    """Names of the flags that hold, in order, joined by '/', with the tail last."""
    return F.concat_ws("/", *[F.when(holds, F.lit(name)) for name, holds in flags], tail)


@query(
    "flag_label",
    """SELECT l_orderkey, l_linenumber, concat_ws('/', CASE WHEN l_discount > 0.05 THEN 'like' END, CASE WHEN l_tax > 0.04 THEN 'share' END, CASE WHEN l_returnflag = 'R' THEN 'dislike' END, CASE WHEN l_linestatus = 'F' OR l_quantity >= 30 THEN 'long' ELSE 'view' END) AS label,
       concat_ws('/', CASE WHEN l_discount > 0.05 THEN 'like' END, CASE WHEN l_quantity / 50 > 0.75 THEN 'long' ELSE 'view' END) AS label_by_ratio FROM lineitem""",
)
def flag_label_query(spark, sf_dir):
    like, share = F.col("l_discount") > 0.05, F.col("l_tax") > 0.04
    by_time = F.when((F.col("l_linestatus") == "F") | (F.col("l_quantity") >= 30), "long").otherwise("view")
    by_ratio = F.when(F.col("l_quantity") / 50 > 0.75, "long").otherwise("view")
    full = flag_label([("like", like), ("share", share), ("dislike", F.col("l_returnflag") == "R")], by_time)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", full.alias("label"), flag_label([("like", like)], by_ratio).alias("label_by_ratio"))


_RULES = "(VALUES ('error', 50.0, 3, 'failed big'), ('error', NULL, 1, 'failed'), ('purchase', 100.0, 5, 'big buy'), ('purchase', 10.0, 4, 'buy'), ('purchase', NULL, 1, 'small buy'), ('view', 20.0, 2, 'long view')) r(action, at_least, priority, phrase)"


def resolve_priority(events: DataFrame, rules: DataFrame) -> DataFrame:
    """``phrase`` of each event: its action's satisfied rule of highest priority; a rule without a condition
    is the fallback; 'unknown' without any.  ``rules`` is a small configuration table."""
    by_action = rules.groupBy("action").agg(F.array_sort(F.collect_list(F.struct((-F.col("priority")).alias("p"), "at_least", "phrase"))).alias("rules"))
    held = F.filter("rules", lambda r: r["at_least"].isNull() | (F.col("value") >= r["at_least"]))
    return events.join(F.broadcast(by_action), "action", "left").withColumn("phrase", F.coalesce(F.try_element_at(held, F.lit(1))["phrase"], F.lit("unknown"))).drop("rules")


@query(
    "priority_rule",
    f"""SELECT event_id, coalesce(arg_max(phrase, priority) FILTER (WHERE at_least IS NULL OR value >= at_least), 'unknown') AS phrase
        FROM ({TIMELINE}) e LEFT JOIN {_RULES} USING (action) GROUP BY event_id""",
)
def priority_rule(spark, sf_dir):
    rules = spark.sql(f"SELECT * FROM {_RULES.replace('NULL', 'CAST(NULL AS DOUBLE)')}")
    return resolve_priority(timeline(spark, sf_dir), rules).select("event_id", "phrase")


@query(
    "action_strength",
    f"""SELECT event_id, greatest(CASE WHEN action = 'purchase' THEN 5 ELSE 0 END, CASE WHEN action = 'signup' THEN 4 ELSE 0 END, CASE WHEN action = 'click' THEN 2 ELSE 0 END, CASE WHEN value > 50 THEN 3 ELSE 0 END) AS strength FROM ({TIMELINE})""",
)
def action_strength(spark, sf_dir):
    is_ = lambda a: F.col("action") == a
    rules = [(is_("purchase"), 5), (is_("signup"), 4), (is_("click"), 2), (F.col("value") > 50, 3)]
    return timeline(spark, sf_dir).select("event_id", strongest(rules).alias("strength"))


@query("hash_split", f"SELECT doc_id, CASE WHEN {hash_rank_sql('split', 'doc_id')} % 10 = 0 THEN 'holdout' ELSE 'train' END AS split FROM documents")
def hash_split(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id").select("doc_id", F.when(hash_rank("split", "doc_id") % 10 == 0, "holdout").otherwise("train").alias("split"))


@query("hash_mod_sample", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey * 8443 + l_partkey * 199 + l_suppkey) % 100 < 1")
def hash_mod_sample(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").filter("(l_orderkey * 8443 + l_partkey * 199 + l_suppkey) % 100 < 1").select("l_orderkey", "l_linenumber")


@query(
    "size_bins",
    """SELECT o_orderkey, n, CASE WHEN n BETWEEN 1 AND 5 THEN '1-5' WHEN n <= 10 THEN '6-10' WHEN n <= 20 THEN '11-20' ELSE '21+' END AS bin, CASE WHEN n <= 4 THEN '1-4' WHEN n <= 10 THEN '5-10' WHEN n <= 19 THEN '11-19' ELSE '20+' END AS stratum
       FROM (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem GROUP BY 1)""",
)
def size_bins(spark, sf_dir):
    n = F.col("n")
    sized = table(spark, sf_dir, "lineitem", "l_orderkey").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return sized.select("o_orderkey", "n", first_rule([("1-5", n.between(1, 5)), ("6-10", n <= 10), ("11-20", n <= 20)], "21+").alias("bin"), first_rule([("1-4", n <= 4), ("5-10", n <= 10), ("11-19", n <= 19)], "20+").alias("stratum"))


@query(
    "constraint_violations",
    """SELECT 'positive_price' AS rule, count(*) FILTER (WHERE NOT coalesce(o_totalprice > 300000, false)) AS n FROM orders UNION ALL
       SELECT 'known_status', count(*) FILTER (WHERE NOT coalesce(o_orderstatus IN ('O', 'F'), false)) FROM orders UNION ALL
       SELECT 'hex_hash', count(*) FILTER (WHERE NOT regexp_matches(sha256(o_orderkey::VARCHAR), '^[0-9a-f]{64}$')) FROM orders""",
)
def constraint_violations(spark, sf_dir):
    rules = {"positive_price": F.col("o_totalprice") > 300000, "known_status": F.col("o_orderstatus").isin("O", "F"), "hex_hash": F.sha2(F.col("o_orderkey").cast("string"), 256).rlike("^[0-9a-f]{64}$")}
    return violations(table(spark, sf_dir, "orders"), rules)

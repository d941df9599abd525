"""Secret scans by linking the parts of a credential.

Patterns give spans of several kinds. Base kinds are reported wherever they stand. Weak
kinds (identifiers, secrets and endpoints that look like many harmless things) are only
reported if the gap to a complementary part, from the end of the earlier to the start of the
later, is at most `reach` code points; this stretch around a part is its scope, and lines,
blocks or sections of a text bound it no further: an identifier or an endpoint needs a secret, a secret
needs an identifier or an endpoint; base spans serve as parts too. The parts are joined by
intervals: each goes to the bins, as wide as the reach, from its start to the reach after its
end, so a bin holds few parts whatever the text; two parts that are near meet in the bin where
the later starts.

DataFrame functions only. Positions come from the pieces between matches: the split of a
text by a pattern and its matches are as many, but for one, and are summed in order.

Defined results: a null text is an empty one; an empty table gives no rows; rows that agree
in doc_id and text share one result; ties of spans go by kind, as listed, then end; only
doc_id and text are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dimspark.llm.common import read_table, settle, text_key

REACH = 300
#: Kind: (pattern, group whose length counts, least length, role, whether it is weak).
KINDS: dict[str, tuple[str, int, int, str, bool]] = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, "secret", False),
    "access": (r"AKIA[A-Z0-9]+", 0, 20, "identifier", False),
    "hex": (r"[0-9a-f]{24,}", 0, 24, "secret", False),
    "identifier": (r"""((?i:client_?id|key_?id|access_?key|user_?name|account_?id|login))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]+)""", 2, 3, "identifier", True),
    "candidate": (r"""((?i:pwd|pass_?phrase|private_?key|credential|auth))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=!@#%-]+)|(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])""", 0, 8, "secret", True),
    "endpoint": (r"""(?:[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]+)|((?i:host|endpoint|server))["']?\x20*[:=]\x20*["']?([A-Za-z0-9._:/-]+)""", 0, 6, "endpoint", True),
}
BASE = ("assign", "access", "hex")
#: Kind: texts one of which stands, in either case, in every match; or else a simpler pattern that every match holds.
HELD: dict[str, tuple[tuple[str, ...], str | None]] = {
    "assign": (("passw", "secret", "token", "apikey", "api_key"), None),
    "access": (("akia",), None),
    "hex": ((), r"[0-9a-f]{24}"),
    "identifier": (("clientid", "client_id", "keyid", "key_id", "accesskey", "access_key", "username", "user_name", "accountid", "account_id", "login"), None),
    "candidate": (("pwd", "passphrase", "pass_phrase", "privatekey", "private_key", "credential", "auth"), r"[A-Za-z0-9+/]{40}"),
    "endpoint": (("://", "host", "endpoint", "server"), None),
}


def _found(text: Column, lowered: Column, kind: str) -> Column:
    """An array of (gap, length, good) for the matches of a kind: the gap before each, in code points; null without any.

    The pattern itself runs only over texts that hold what every match holds.
    """
    names, simpler = HELD[kind]
    may = reduce(Column.__or__, [F.contains(lowered, F.lit(n)) for n in names] + ([text.rlike(simpler)] if simpler else []))
    pattern, group, least, _, _ = KINDS[kind]
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    whole = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    good = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: F.length(x) >= least)
    zipped = F.zip_with(F.zip_with(F.slice(gaps, F.lit(1), F.size(whole)), whole, lambda g, n: F.struct(g.alias("gap"), n.alias("length"))), good, lambda x, y: F.struct(x["gap"].alias("gap"), x["length"].alias("length"), y.alias("good")))
    return F.when(may & text.rlike(pattern), zipped)


def find_parts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, key) and parts (key, kind, role, weak, start, end) of the texts."""
    body = docs.select(F.col(doc_id).alias("doc_id"), text_key(doc_id, text).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    body = body.withColumn("lowered", F.lower("body"))
    scanned = settle(body.select("doc_id", "key", *[_found(F.col("body"), F.col("lowered"), k).alias(k) for k in KINDS]))
    hits = scanned.where(" or ".join(f"`{k}` is not null" for k in KINDS)).drop("doc_id").dropDuplicates(["key"])
    listed = F.array(*[F.struct(F.lit(i).alias("order"), F.lit(k).alias("kind"), F.col(k).alias("found")) for i, k in enumerate(KINDS)])
    each = hits.select("key", F.explode(listed).alias("k")).select("key", "k.order", "k.kind", F.posexplode("k.found").alias("i", "m"))
    end = F.expr("sum(m.gap + m.length) over (partition by key, `order` order by i rows between unbounded preceding and current row)").cast("int")
    placed = each.withColumn("end", end).where("m.good").select("key", "order", "kind", (F.col("end") - F.col("m.length")).alias("start"), "end")
    role = F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v[3])])[F.col("kind")]
    return scanned.select("doc_id", "key"), settle(placed.select("key", "order", "kind", role.alias("role"), (~F.col("kind").isin(*BASE)).alias("weak"), "start", "end"))


def link_parts(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """The parts that are reported: base ones, and weak ones with a complementary part within reach."""
    strong = parts.where(~F.col("weak"))
    weak = parts.where("weak").join(strong.select("key", "start", "end").distinct(), ["key", "start", "end"], "left_anti")
    bins = lambda: F.explode(F.sequence(F.floor(F.col("start") / reach), F.floor((F.col("end") + reach) / reach)))
    binned = weak.withColumn("at", bins())
    other = parts.select(F.col("key").alias("o_key"), F.col("role").alias("o_role"), F.col("start").alias("o_start"), F.col("end").alias("o_end"), bins().alias("o_at"))
    complementary = F.when(F.col("role") == "secret", F.col("o_role") != "secret").otherwise(F.col("o_role") == "secret")
    near = (F.col("o_start") <= F.col("end") + reach) & (F.col("start") <= F.col("o_end") + reach)
    linked = binned.join(other, (F.col("key") == F.col("o_key")) & (F.col("at") == F.col("o_at")) & near & complementary, "left_semi")
    return strong.unionByName(linked.select(*parts.columns).distinct())


def scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id and spans (an array of start, order, end, kind, sorted; null without any) of each row."""
    rows, parts = find_parts(docs)
    reported = link_parts(parts, reach).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "order", "end", "kind"))).alias("spans"))
    return rows.join(reported, "key", "left").drop("key")


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read_table(spark, sf_dir, "documents"))
    spans = F.coalesce("spans", F.expr("array()").cast(found.schema["spans"].dataType))
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))

"""Secrets in texts, and weak candidates that count only near their complement, on DataFrame functions only.

Base patterns report their spans by themselves. Parts of a credential that say little
alone (an account name, a short assigned value, an endpoint, a long mixed token) are
reported only if complementary parts stand within the same scope. Parts and base
spans meet by an interval join: text is cut into stretches as long as the scope, a span
enters every stretch that it touches, each stretch keeps the least start and greatest
end of each role, and a part looks at its own stretches and the two beside them. That
is exact and makes no row for a pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, fresh

#: Base kinds in the order of their listing: name, pattern, the group whose length counts, and its least length.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (
    ("assign", ASSIGN, 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
_SCHEME = r"""\b(?:https?|postgres(?:ql)?|mysql|mongodb|redis|ftp|ssh|jdbc:[a-z]+)://"""
#: Weak kinds: name, role and pattern. A short assignment is an `assign` match that failed by length. A mixed token is
#: the first group of its pattern, which takes whole addresses first: a token in one's own path or query is part of it.
WEAK = (
    ("account", "id", r"""\b(?i:user(?:name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@_.-]{3,}"""),
    ("endpoint", "where", _SCHEME + r"""[A-Za-z0-9._~:@/-]+"""),
    ("mixed", "secret", _SCHEME + r"""[^\s"'<>]+|(?<![A-Za-z0-9+/_-])((?=[A-Za-z+/_-]*[0-9])(?=[0-9A-Z+/_-]*[a-z])(?=[0-9a-z+/_-]*[A-Z])[A-Za-z0-9+/_-]{24,})"""),
)
_ROLE = {"assign": "secret", "access": "id", "hex": "secret", "short": "secret"} | {kind: role for kind, role, _ in WEAK}
_ORDER = ["assign", "access", "hex", "short", "account", "endpoint", "mixed"]


def _matches(df: DataFrame, out: str, text: str, pattern: str, group: int) -> DataFrame:
    """`out`: (start, end, size of the group) of each match, leftmost and non-overlapping, in code points.

    Splitting at the pattern and extracting it give the pieces between matches and the
    matches themselves; running sums of their lengths are the places. Texts without a
    match skip all that.
    """
    between, found, groups, places = f"{out}_between", f"{out}_found", f"{out}_groups", f"{out}_at"
    p = F.lit(pattern)
    none = F.array().cast("array<string>")
    any_match = F.col(text).rlike(pattern)
    df = df.withColumn(found, F.when(any_match, F.regexp_extract_all(text, p, F.lit(0))).otherwise(none))
    df = df.withColumn(groups, F.when(F.size(found) > 0, F.regexp_extract_all(text, p, F.lit(group))).otherwise(none))
    df = df.withColumn(between, F.when(F.size(found) > 0, F.slice(F.split(text, pattern, -1), 1, F.size(found))).otherwise(none))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,size:int>>").alias("out"))
    size = F.arrays_zip(F.transform(between, F.char_length).alias("b"), F.transform(found, F.char_length).alias("f"), F.transform(groups, F.char_length).alias("g"))

    def step(acc: Column, x: Column) -> Column:
        lo = acc["at"] + x["b"]
        hi = lo + x["f"]
        return F.struct(hi.alias("at"), F.concat(acc["out"], F.array(F.struct(lo.alias("start"), hi.alias("end"), x["g"].alias("size")))).alias("out"))

    df = df.withColumn(places, F.when(F.size(found) > 0, size).otherwise(F.array().cast("array<struct<b:int,f:int,g:int>>")))
    return df.withColumn(out, F.aggregate(places, start, step, lambda acc: acc["out"])).drop(between, found, groups, places)


def secret_spans(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scope: int = 200) -> tuple[DataFrame, DataFrame]:
    """(rows with their base spans, further spans).

    The first has doc_id, text_hash and base (array of kind, start, end) for each row;
    the second doc_id, text_hash, kind, start, end of weak parts that have a complement:
    an identifier or endpoint near a secret, or a secret near either, with at most `scope`
    code points from the end of one to the start of the other. A base span counts as a
    complement.
    """
    df = documents.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    for kind, pattern, group, _ in BASE:
        df = _matches(df, kind, "text", pattern, group)
    for kind, _, pattern in WEAK:
        df = _matches(df, kind, "text", pattern, int(kind == "mixed"))

    def named(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    def long_enough(kind: str, least: int) -> Column:
        return F.filter(kind, lambda x: x["size"] >= least)

    base = F.concat(*(named(kind, long_enough(kind, least)) for kind, _, _, least in BASE))
    weak = F.concat(named("short", F.filter("assign", lambda x: x["size"] < BASE[0][3])), *(named(kind, F.filter(kind, lambda x: x["size"] > 0)) for kind, _, _ in WEAK))
    made = checkpoint(df.select("doc_id", "text_hash", base.alias("base"), weak.alias("weak")))

    role = F.create_map(*(F.lit(x) for pair in _ROLE.items() for x in pair))
    part = made.where("size(weak) > 0").select("doc_id", "text_hash", F.explode(F.concat(F.transform("base", lambda x: F.struct(F.lit(True).alias("strong"), x.alias("s"))), F.transform("weak", lambda x: F.struct(F.lit(False).alias("strong"), x.alias("s"))))).alias("p"))
    part = part.select("doc_id", "text_hash", "p.strong", "p.s.*").distinct().withColumn("role", role[F.col("kind")])
    part = part.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))))
    # Every kind of complement for each role; least start and greatest end of each role in each stretch. A span that
    # touches the stretch after a part's last can only be too far by its start, one before its first only by its end.
    edge = part.groupBy("doc_id", "text_hash", "stretch").agg(*(f(F.when(F.col("role") == r, F.col(c))).alias(f"{name}_{r}") for r in ("id", "secret", "where") for name, f, c in (("first", F.min, "start"), ("last", F.max, "end"))))
    near = edge.withColumn("by", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("stretch", F.col("stretch") + F.col("by")).drop("by")
    near = near.withColumnsRenamed({"doc_id": "d", "text_hash": "t", "stretch": "n"})
    weak_part = part.where("NOT strong")
    met = weak_part.join(near, weak_part.doc_id.eqNullSafe(near.d) & (weak_part.text_hash == near.t) & (weak_part.stretch == near.n))

    def by(r: str) -> Column:
        return F.coalesce((F.col(f"first_{r}") <= F.col("end") + scope) & (F.col(f"last_{r}") >= F.col("start") - scope), F.lit(False))

    linked = met.where(F.when(F.col("role") == "secret", by("id") | by("where")).otherwise(by("secret")))
    return made.select("doc_id", "text_hash", "base"), linked.select("doc_id", "text_hash", "kind", "start", "end").distinct()


def scan_secrets(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scope: int = 200) -> DataFrame:
    """One row for each row of `documents`: doc_id, text_hash, n_assign, n_access, n_hex, base_sha256, spans, and `found`, the spans as an array.

    `spans` lists kind:start:end by start, then kind as listed, comma-joined; ends are
    exclusive and count code points. Base spans always stand there; base_sha256 is of
    them alone. Null and empty texts have none. Rows are told apart by id and text, so
    ids may repeat or be null; other columns are ignored.
    """
    made, extra = secret_spans(documents, id_col=id_col, text_col=text_col, scope=scope)
    extra = extra.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).agg(F.collect_list(F.struct("kind", "start", "end")).alias("extra"))
    rows = made.join(extra, made.doc_id.eqNullSafe(extra.d) & (made.text_hash == extra.t), "left")
    order = F.array(*(F.lit(k) for k in _ORDER))

    def sorted_spans(spans: Column) -> Column:
        keyed = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.array_position(order, x["kind"]).alias("k"), x["end"].alias("end"), x["kind"].alias("kind")))
        return F.array_sort(keyed)

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    every = F.concat("base", F.coalesce("extra", F.array().cast("array<struct<kind:string,start:int,end:int>>")))
    rows = rows.select("doc_id", "text_hash", "base", sorted_spans(every).alias("found"))
    return rows.select("doc_id", "text_hash", *(count(kind) for kind, *_ in BASE), F.sha2(joined(sorted_spans(F.col("base"))).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), "found")


def redact_secrets(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]", scope: int = 200) -> DataFrame:
    """`documents` with every reported span of its text replaced by `mark`; overlapping spans give one mark. Other rows are as they were."""
    h, d, t, spans = fresh(documents, "_h", "_d", "_t", "_found")
    found = scan_secrets(documents, id_col=id_col, text_col=text_col, scope=scope).where("size(found) > 0").select(F.col("doc_id").alias(d), F.col("text_hash").alias(t), F.col("found").alias(spans)).distinct()
    rows = documents.withColumn(h, F.xxhash64(text_col)).join(found, F.col(id_col).eqNullSafe(F.col(d)) & (F.col(h) == F.col(t)), "left")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        kept = F.substring(F.col(text_col), acc["at"] + 1, x["start"] - acc["at"])
        fresh = F.concat(acc["out"], F.array(kept, F.lit(mark)))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col(text_col), acc["at"] + 1, F.char_length(text_col))))
    return rows.withColumn(text_col, F.when(F.col(spans).isNotNull(), done).otherwise(F.col(text_col))).select(documents.columns)

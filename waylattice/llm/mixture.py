"""Mixtures of sources at target shares of tokens, by Pareto order sampling."""

from __future__ import annotations

import base64
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Folder of the public vocabularies, and the one whose tokens are counted.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: Split of a text into pieces that belongs to the vocabulary (fixed value).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bins of the sampling order per pass, and documents of a bin from which it is bisected again.
BINS, BIN_DOCS = 4096, 50_000


def count_tokens(texts: DataFrame, vocabulary: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """(doc, source, weight, text) to (doc, source, weight, tokens); null and empty texts have none."""
    schema = pa.schema([("doc", pa.int64()), ("source", pa.string()), ("weight", pa.float64()), ("tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        coder = tiktoken.Encoding("vocabulary", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            n = np.fromiter((len(coder.encode_ordinary(t)) if t else 0 for t in batch.column(3).to_pylist()), np.int64, batch.num_rows)
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(n)], schema=schema)

    return texts.select("doc", "source", "weight", "text").mapInArrow(run, "doc BIGINT, source STRING, weight DOUBLE, tokens BIGINT")


def _spread(doc: Column, seed: int) -> Column:
    """Number in (0, 1) that depends on the document and the seed alone."""
    return (F.pmod(F.xxhash64(doc, F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def mix_sources(
    documents: DataFrame,
    targets: DataFrame,
    *,
    total_tokens: int | None = None,
    weight: str | None = None,
    by_size: bool = False,
    seed: int = 17,
    vocabulary: str = f"{TOKENIZERS}/{VOCABULARY}",
) -> DataFrame:
    """Documents and copies of a mixture in which each source has its share of the tokens.

    ``documents``: doc_id, source, text (and ``weight``, a positive number that a
    document's expected copies are proportional to; with ``by_size`` its tokens
    are that number, so that long documents are drawn more often than short ones;
    else all count alike);
    ``targets``: source, target_share, max_repeats. Names of sources are compared
    without case and blanks at the ends. Documents of no target are left out, as
    are null ids; targets of null source, a share that is not positive, or no
    tokens can't be met: the others share their part in proportion. Of a source
    named twice the first target by share counts. An id that occurs twice counts
    once, with its least source and most tokens.

    The total is the greatest that every source can fill with at most
    max_repeats copies of each document, or ``total_tokens`` if that is less.
    Each document gets the whole part of its expected copies for certain; the
    rest of a source's tokens are drawn by Pareto order sampling: documents are
    ranked by the odds of a random number over the odds of their inclusion, and
    the first are taken until the tokens are reached, so a source misses its
    tokens by less than one document. The order is found by counting tokens per
    bin of the rank, never by sorting a source.

    Returns (doc_id, source, n_tokens, copies, target_share, reached_share,
    reached_tokens) for each document used.
    """
    name = F.lower(F.trim(F.col("source")))
    value = F.lit(1.0) if weight is None else F.coalesce(F.when(F.col(weight) > 0, F.col(weight).cast("double")), F.lit(0.0))
    goals = (
        targets.where("source IS NOT NULL AND target_share > 0 AND NOT isnan(target_share) AND max_repeats > 0")
        .select(name.alias("source"), F.struct(F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("most")).alias("t"))
        .groupBy("source").agg(F.max("t").alias("t")).select("source", "t.share", "t.most")
    )
    wanted = [(r["source"], r["share"], r["most"]) for r in goals.collect()]  # one row per target
    spark = documents.sparkSession
    small = spark.createDataFrame(wanted, "source STRING, share DOUBLE, most INT")
    texts = documents.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc"), name.alias("source"), value.alias("weight"), "text")
    counted = count_tokens(texts.join(F.broadcast(small.select("source")), "source"), vocabulary)
    docs = cut(counted.groupBy("doc").agg(F.min("source").alias("source"), F.max("weight").alias("weight"), F.max("tokens").alias("tokens")).where("tokens > 0 AND weight > 0"))
    if by_size:
        docs = docs.withColumn("weight", F.col("weight") * F.col("tokens"))

    plan = _plan(docs, small, total_tokens)
    rates = spark.createDataFrame([(s, p["rate"], p["most"]) for s, p in plan.items()], "source STRING, rate DOUBLE, most INT")
    expected = F.least(F.col("most").cast("double"), F.col("rate") * F.col("weight"))
    held = docs.join(F.broadcast(rates), "source").withColumn("expected", expected)
    whole = F.floor(F.col("expected") + 1e-9)
    part = F.greatest(F.lit(0.0), F.col("expected") - whole)
    u = _spread(F.col("doc"), seed)
    rank = (u / (1 - u)) / (part / (1 - part))
    # the order as a number in (0, 1); documents without a fractional part come last and are never drawn
    held = cut(held.withColumn("whole", whole).withColumn("z", F.when(part > 1e-9, rank / (1 + rank)).otherwise(F.lit(2.0))).drop("most", "rate"))
    sure = {r["source"]: r["n"] for r in held.groupBy("source").agg(F.sum(F.col("whole") * F.col("tokens")).alias("n")).collect()}
    need = {s: p["tokens"] - sure.get(s, 0) for s, p in plan.items()}
    drawn = _first_by_rank(held, need)
    used = drawn.withColumn("copies", (F.col("whole") + F.col("extra")).cast("int")).where("copies > 0").select("doc", "source", "tokens", "copies")
    used = cut(used)
    reached = {r["source"]: r["n"] for r in used.groupBy("source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("n")).collect()}
    total = sum(reached.values())
    shares = spark.createDataFrame([(s, p["share"], reached.get(s, 0) / total if total else 0.0, reached.get(s, 0)) for s, p in plan.items()], "source STRING, target_share DOUBLE, reached_share DOUBLE, reached_tokens BIGINT")
    return used.join(F.broadcast(shares), "source").select(
        F.col("doc").alias("doc_id"), "source", F.col("tokens").alias("n_tokens"), "copies", "target_share", "reached_share", "reached_tokens",
    )


def _plan(docs: DataFrame, targets: DataFrame, total_tokens: int | None) -> dict[str, dict]:
    """Per source that can be filled: its share of the total, its tokens, and the expected copies per weight."""
    held = {
        r["source"]: r for r in docs.join(F.broadcast(targets), "source").groupBy("source", "share", "most")
        .agg(F.sum("tokens").cast("double").alias("tokens"), F.sum(F.col("tokens") * F.col("weight")).alias("weighed")).collect()
    }
    whole = sum(r["share"] for r in held.values())
    if not whole:
        return {}
    total = min(r["tokens"] * r["most"] / (r["share"] / whole) for r in held.values())
    if total_tokens is not None:
        total = min(total, float(total_tokens))
    plan = {s: {"share": r["share"], "most": r["most"], "tokens": total * r["share"] / whole, "rate": total * r["share"] / whole / r["weighed"]} for s, r in held.items()}
    # where some documents reach their cap the rate of the others rises, until the tokens fit
    spark = docs.sparkSession
    for _ in range(60):
        rates = spark.createDataFrame([(s, p["rate"], p["most"]) for s, p in plan.items()], "source STRING, rate DOUBLE, most INT")
        capped = F.col("rate") * F.col("weight") >= F.col("most")
        sums = docs.join(F.broadcast(rates), "source").groupBy("source", "most").agg(
            F.sum(F.when(capped, F.col("tokens") * F.col("most")).otherwise(0)).alias("full"), F.sum(F.when(~capped, F.col("tokens") * F.col("weight")).otherwise(0.0)).alias("open"),
        ).collect()
        moved = False
        for r in sums:
            p = plan[r["source"]]
            if r["open"] > 0:
                rate = (p["tokens"] - r["full"]) / r["open"]
                moved |= rate > p["rate"] * (1 + 1e-9)
                p["rate"] = max(p["rate"], rate)
        if not moved:
            return plan
    warnings.warn("rates of the mixture did not settle; shares are met all the same, inclusion is only near the wanted odds", stacklevel=2)
    return plan


def _first_by_rank(held: DataFrame, need: dict[str, float]) -> DataFrame:
    """Adds ``extra``: 1 for the documents of each source that come first by (z, doc) until their tokens reach ``need``.

    Each pass counts tokens in bins of every source's interval of z and narrows
    the interval to the bin in which the need is met; a bin of few documents is
    sorted at last.
    """
    spark = held.sparkSession
    span = {s: (0.0, 1.0, max(n, 0.0)) for s, n in need.items()}
    for _ in range(5):  # 4096 ** 5 exceeds the resolution of z
        state = spark.createDataFrame([(s, lo, hi) for s, (lo, hi, _) in span.items()], "source STRING, lo DOUBLE, hi DOUBLE")
        inside = held.join(F.broadcast(state), "source").where("z >= lo AND z < hi")
        bins = inside.groupBy("source", F.least(F.lit(BINS - 1), F.floor((F.col("z") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS)).alias("b")).agg(F.sum("tokens").alias("t"), F.count("*").alias("c"))
        open_bins, found = False, {}
        for r in sorted(bins.collect(), key=lambda r: (r["source"], r["b"])):  # sources x BINS at most
            lo, hi, left = span[r["source"]]
            if r["source"] in found and found[r["source"]][3]:
                continue
            left = found[r["source"]][2] if r["source"] in found else left
            width = (hi - lo) / BINS
            if left <= r["t"]:
                found[r["source"]] = (lo + r["b"] * width, lo + (r["b"] + 1) * width, left, True)
                open_bins |= r["c"] > BIN_DOCS
            else:
                found[r["source"]] = (hi, hi, left - r["t"], False)
        for s, (lo, hi, left, _) in found.items():
            span[s] = (lo, hi, left)
        if not open_bins:
            break
    edges = spark.createDataFrame([(s, *x) for s, x in span.items()], "source STRING, lo DOUBLE, hi DOUBLE, left DOUBLE")
    at = held.join(F.broadcast(edges), "source")
    before = F.sum("tokens").over(Window.partitionBy("source").orderBy("z", "doc").rowsBetween(Window.unboundedPreceding, -1))
    # the bin of the edge: taken while half of the next document still fits
    edge = at.where("z >= lo AND z < hi").withColumn("before", F.coalesce(before, F.lit(0)))
    edge = edge.withColumn("extra", (F.col("before") + F.col("tokens") / 2 <= F.col("left")).cast("int")).drop("before")
    rest = at.where("NOT (z >= lo AND z < hi)").withColumn("extra", (F.col("z") < F.col("lo")).cast("int"))
    return edge.unionByName(rest).drop("lo", "hi", "left")

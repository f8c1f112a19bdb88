"""Documents of several sources mixed so that each source gives its share of all tokens.

A document's rate, the mean number of its copies, is the exponential of a multiple of its length in tokens, up to the
source's cap: of all rates that give the wanted tokens these are nearest to one copy of each document in relative
entropy. The multiples are the solution of a convex dual problem, found by Newton steps whose sums are taken over all
documents by the executors. Rates are then rounded to copies in order of length, so that the rounding errors of
neighbours cancel, and what a source still lacks or has too much in tokens is made up by single copies.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.grouped import positions
from corpusloom.session import settle

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass(frozen=True)
class MixConfig:
    """tokenizer: path of a sentencepiece model on the driver; steps: most Newton steps; precise: relative error of a source's
    tokens at which they end; piece: documents ordered in one task when rates are rounded; seed: of that order's start;
    fixes: most copies a source that are added or taken back after rounding."""

    tokenizer: str = TOKENIZER
    steps: int = 40
    precise: float = 1e-7
    piece: int = 50_000
    seed: int = 3
    fixes: int = 8


def source_name(source: Column) -> Column:
    """A source in one spelling: lower case, no outer blanks, underscores for hyphens and blanks; null for a blank one."""
    name = F.regexp_replace(F.lower(F.regexp_replace(source, r"^\s+|\s+$", "")), r"[-\s]+", "_")
    return F.when(name != "", name)


def _counter(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece
        from pyspark import SparkFiles

        model = sentencepiece.SentencePieceProcessor(model_file=SparkFiles.get(name))
        for batch in batches:
            made = model.encode(batch.column(2).to_pylist(), num_threads=1) if batch.num_rows else []
            yield pa.record_batch({"doc_id": batch.column(0), "source": batch.column(1), "tokens": pa.array([len(m) for m in made], pa.int64())})

    return run


def count_tokens(documents: DataFrame, sources: list[str], tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) of the documents of these sources; null and empty texts and texts of no token are left out.

    The tokenizer is read on the driver and sent to the executors as a file of the application.
    """
    documents.sparkSession.sparkContext.addFile(tokenizer)
    rows = documents.select("doc_id", source_name(F.col("source")).alias("source"), "text").where(F.col("source").isin(*sources) & (F.length("text") > 0))
    return rows.mapInArrow(_counter(os.path.basename(tokenizer)), "doc_id long, source string, tokens long").where("tokens > 0")


def reachable(tokens: dict[str, int], shares: dict[str, float], caps: dict[str, int]) -> float:
    """The most tokens at which every source that has documents can give its share of them."""
    held = [s for s in shares if tokens.get(s) and shares[s] > 0]
    whole = sum(shares[s] for s in held)
    return min((caps[s] * tokens[s] * whole / shares[s] for s in held), default=0.0)


def solve_rates(histogram: DataFrame, wanted: dict[str, float], caps: dict[str, int], means: dict[str, float], config: MixConfig) -> dict[str, float]:
    """source -> multiplier of tokens / mean in the exponent; infinite where only the cap gives the wanted tokens.

    histogram: source, tokens, n. Each step sums f(x) = sum n * tokens * min(cap, exp(x * tokens / mean)) and its slope
    for all sources in one aggregate; a step that would leave the known interval halves it instead.
    """
    spark = histogram.sparkSession
    x = dict.fromkeys(wanted, 0.0)
    low, high = dict.fromkeys(wanted, -math.inf), dict.fromkeys(wanted, math.inf)
    done: set[str] = set()
    for _ in range(config.steps):
        now = spark.createDataFrame([(s, float(x[s]), means[s], float(caps[s])) for s in sorted(x) if s not in done], "source string, x double, mean double, cap double")
        h = histogram.join(F.broadcast(now), "source")  # a row a source with a target
        z = F.col("x") * F.col("tokens") / F.col("mean")
        rate = F.least(F.exp(F.least(z, F.lit(60.0))), F.col("cap"))
        mass = F.col("n") * F.col("tokens")
        slope = F.when(z < F.ln("cap"), mass * rate * F.col("tokens") / F.col("mean")).otherwise(0.0)
        sums = h.groupBy("source").agg(F.sum(mass * rate).alias("f"), F.sum(slope).alias("d"), F.sum(mass).alias("all")).collect()
        for r in sums:
            s, gap = r["source"], r["f"] - wanted[r["source"]]
            if wanted[s] >= caps[s] * r["all"] * (1 - 1e-9):
                x[s] = math.inf
                done.add(s)
            elif abs(gap) <= config.precise * wanted[s]:
                done.add(s)
            else:
                if gap > 0:
                    high[s] = x[s]
                else:
                    low[s] = x[s]
                step = x[s] - gap / r["d"] if r["d"] > 0 else math.nan
                if not low[s] < step < high[s]:
                    step = (low[s] + high[s]) / 2 if math.isfinite(low[s] + high[s]) else (x[s] * 2 + (1 if gap < 0 else -1))
                x[s] = step
        if len(done) == len(wanted):
            break
    else:
        if wanted:
            raise RuntimeError(f"no rates for {sorted(set(wanted) - done)} after {config.steps} steps")
    return {s: v if math.isinf(v) else float(f"{v:.9g}") for s, v in x.items()}


def _fixes(rounded: DataFrame, wanted: dict[str, float], caps: dict[str, int], most: int) -> list[tuple[int, int]]:
    """(doc_id, copies to add, which may be -1): each round takes in every source the largest document that isn't larger than
    what is lacking (or too much) and has a copy to give, so what is left shrinks to less than a short document."""
    spark = rounded.sparkSession
    got = {r["source"]: r["t"] for r in rounded.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("t")).collect()}  # a row a source
    left = {s: w - got.get(s, 0) for s, w in wanted.items()}
    made: list[tuple[int, int]] = []
    for _ in range(most):
        now = spark.createDataFrame([(s, float(v), caps[s]) for s, v in left.items()], "source string, lacks double, cap int")
        used = spark.createDataFrame([(d,) for d, _ in made], "doc_id long")
        fit = rounded.join(F.broadcast(now), "source").where("tokens <= abs(lacks) and if(lacks > 0, copies < cap, copies > 0)")
        fit = fit.join(F.broadcast(used), "doc_id", "left_anti")
        best = fit.groupBy("source").agg(F.max(F.struct("tokens", "doc_id")).alias("b"), F.first("lacks").alias("lacks")).select("source", "b.*", "lacks").collect()
        if not best:
            break
        for r in best:
            way = 1 if r["lacks"] > 0 else -1
            left[r["source"]] -= way * r["tokens"]
            made.append((r["doc_id"], way))
    return made


def mix(documents: DataFrame, targets: DataFrame, config: MixConfig = MixConfig(), total: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Two tables: copies (doc_id, source, tokens, rate, copies), without documents of no copy, and the report.

    report: source, target_share, wanted_share, documents, available_tokens, copies, tokens, share, most_copies. Shares of
    sources without documents are spread over the others in proportion (wanted_share). ``total`` tokens are mixed, but at
    most those at which all shares can be met. Documents without source, or of a source without target, get no copy.
    """
    spark = documents.sparkSession
    goals = {r["source"]: r for r in targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").where("target_share > 0 and max_repeats > 0").collect()}
    shares, caps = {s: float(r["target_share"]) for s, r in goals.items()}, {s: int(r["max_repeats"]) for s, r in goals.items()}
    counted = settle(count_tokens(documents, sorted(goals), config.tokenizer), "tokens")
    histogram = settle(counted.groupBy("source", "tokens").agg(F.count("*").alias("n")), "histogram")
    held = histogram.groupBy("source").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("tokens")).alias("tokens"), F.max("n").alias("most")).collect()
    tokens, docs = {r["source"]: r["tokens"] for r in held}, {r["source"]: r["docs"] for r in held}
    most = reachable(tokens, shares, caps)
    size = min(most, total) if total else most
    whole = sum(shares[s] for s in tokens) or 1.0
    wanted = {s: size * shares[s] / whole for s in tokens}
    means = {s: tokens[s] / docs[s] for s in tokens}
    x = solve_rates(histogram, wanted, caps, means, config) if tokens else {}
    terms = spark.createDataFrame([(s, x[s], means[s], float(caps[s])) for s in x], "source string, x double, mean double, cap double")
    z = F.when(F.col("x") == float("inf"), F.lit(60.0)).otherwise(F.least(F.col("x") * F.col("tokens") / F.col("mean"), F.lit(60.0)))
    rated = counted.join(F.broadcast(terms), "source").withColumn("rate", F.least(F.exp(z), F.col("cap")))
    unit = 1 << 20  # whole numbers, so that sums don't depend on their order
    rated = rated.select("doc_id", "source", "tokens", "rate").withColumn("part", F.round((F.col("rate") - F.floor("rate")) * unit).cast("long"))
    salts = max(1, -(-max((r["most"] for r in held), default=0) // config.piece))
    steps = max(1, -(-max(docs.values(), default=0) // config.piece))
    bucket = F.floor(F.log2("tokens") * min(64, 4 * steps)) * salts + F.pmod(F.xxhash64("doc_id", F.lit(config.seed)), F.lit(salts))
    placed = positions(rated, ["source"], bucket, [F.col("tokens"), F.col("doc_id")], "sum", F.col("part"))
    start = F.pmod(F.xxhash64("source", F.lit(config.seed)), F.lit(unit))
    more = F.expr("1L") * (F.floor((F.col("sum") + start) / unit) - F.floor((F.col("sum") - F.col("part") + start) / unit))
    rounded = settle(placed.withColumn("copies", (F.floor("rate") + more).cast("int")).select("doc_id", "source", "tokens", "rate", "copies"), "copies")
    fixed = spark.createDataFrame(_fixes(rounded, wanted, caps, config.fixes), "doc_id long, more int")
    copies = rounded.join(F.broadcast(fixed), "doc_id", "left")  # at most config.fixes rows a source
    copies = copies.withColumn("copies", F.col("copies") + F.coalesce("more", F.lit(0))).where("copies > 0").drop("more")
    goal = spark.createDataFrame([(s, shares[s], wanted.get(s, 0.0) / size if size else 0.0, docs.get(s, 0), tokens.get(s, 0)) for s in goals], "source string, target_share double, wanted_share double, documents long, available_tokens long")
    got = copies.groupBy("source").agg(F.sum(F.col("copies").cast("long")).alias("copies"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens"), F.max("copies").alias("most_copies"))
    everything = F.sum("tokens").over(Window.partitionBy(F.lit(0)))  # over one row a source
    report = goal.join(got, "source", "left").withColumn("share", F.coalesce(F.col("tokens") / everything, F.lit(0.0)))
    return copies, report.select(*goal.columns, F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("tokens", F.lit(0)).alias("tokens"), "share", F.coalesce("most_copies", F.lit(0)).alias("most_copies"))

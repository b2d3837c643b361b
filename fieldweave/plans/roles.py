"""The analysis roles (crops, plots, markers, samples, results) read from the test tables.

Each role exists twice: as a DataFrame and as the SQL text of the same rows. Row counts grow with
the tables; only the sample list (nation x market segment) has a fixed bound, as a marker panel has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .registry import Tables

GENOME_BP = 50_000_000

# ------------------------------------------------------------------ crops
CROPS = """(SELECT vec_id, vec_id // 2 AS image_no, (vec_id % 2)::INT AS crop_index,
  'dir/' || (vec_id // 2) || '_LeafA-05_00_' || (vec_id % 2) || '.png' AS image_path,
  (vec_id // 2) || '_LeafA' AS image_id, 'G' || label AS genotype, embedding AS features FROM embeddings)"""


def crops(t: Tables) -> DataFrame:
    no = F.expr("vec_id div 2")
    return t.embeddings.select(
        "vec_id",
        no.alias("image_no"),
        (F.col("vec_id") % 2).cast("int").alias("crop_index"),
        F.concat(F.lit("dir/"), no, F.lit("_LeafA-05_00_"), F.col("vec_id") % 2, F.lit(".png")).alias("image_path"),
        F.concat(no, F.lit("_LeafA")).alias("image_id"),
        F.concat(F.lit("G"), "label").alias("genotype"),
        F.col("embedding").alias("features"),
    )


# Long form of the crop features, one row per dimension.
CROPS_LONG = f"""(SELECT vec_id, image_no, genotype, i - 1 AS dim, features[i]::DOUBLE AS value
  FROM {CROPS} c, range(1, 65) g(i))"""


def features_long(df: DataFrame, *keep: str, vec: str = "features") -> DataFrame:
    return df.select(*keep, F.posexplode(vec).alias("dim", "value")).withColumn(
        "value", F.col("value").cast("double")
    )


# ------------------------------------------------------------------ scored images
SCORES = """(SELECT c_custkey AS image_no, c_custkey || '_LeafA' AS image_id, c_mktsegment AS environment,
  c_acctbal AS score FROM customer)"""


def scores(t: Tables) -> DataFrame:
    return t.customer.select(
        F.col("c_custkey").alias("image_no"),
        F.concat("c_custkey", F.lit("_LeafA")).alias("image_id"),
        F.col("c_mktsegment").alias("environment"),
        F.col("c_acctbal").alias("score"),
    )


# ------------------------------------------------------------------ field plots
PLOTS = """(SELECT l_returnflag AS environment, 'S' || l_suppkey AS genotype, (l_orderkey % 40)::INT AS plot,
  ((l_orderkey % 40) // 8)::INT AS "row", (l_orderkey % 8)::INT AS col, (l_orderkey % 2)::INT AS device,
  l_extendedprice AS price, l_discount AS discount, l_tax AS tax, l_quantity AS area FROM lineitem)"""


def plots(t: Tables) -> DataFrame:
    k = F.col("l_orderkey") % 40
    return t.lineitem.select(
        F.col("l_returnflag").alias("environment"),
        F.concat(F.lit("S"), "l_suppkey").alias("genotype"),
        k.cast("int").alias("plot"),
        F.expr("(l_orderkey % 40) div 8").cast("int").alias("row"),
        (F.col("l_orderkey") % 8).cast("int").alias("col"),
        (F.col("l_orderkey") % 2).cast("int").alias("device"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.col("l_quantity").alias("area"),
    )


PLOT_MEANS = f"""(SELECT environment, genotype, plot, "row", col, device, avg(price) AS price,
  avg(discount) AS discount, avg(tax) AS tax, avg(area) AS area FROM {PLOTS} p
  GROUP BY environment, genotype, plot, "row", col, device)"""

PLOT_KEYS = ["environment", "genotype", "plot", "row", "col", "device"]


# ------------------------------------------------------------------ trait observations
OBS = """(SELECT event_type AS trait, 'E' || (user_id % 5) AS env, 'U' || user_id AS genotype, value FROM events)"""


def observations(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("event_type").alias("trait"),
        F.concat(F.lit("E"), F.col("user_id") % 5).alias("env"),
        F.concat(F.lit("U"), "user_id").alias("genotype"),
        "value",
    )


# ------------------------------------------------------------------ markers, samples, dosage
MARKERS = f"""(SELECT 'M' || p_partkey AS marker, (p_partkey % 5 + 1)::INT AS chrom,
  (p_partkey * 7919) % {GENOME_BP} + 1 AS pos,
  CASE p_partkey % 2 WHEN 0 THEN 'A' ELSE 'C' END AS ref,
  CASE p_partkey % 3 WHEN 0 THEN 'G' ELSE 'T' END AS alt FROM part)"""


def _marker_cols(key: str):
    k = F.col(key)
    return [
        F.concat(F.lit("M"), k).alias("marker"),
        (k % 5 + 1).cast("int").alias("chrom"),
        ((k * 7919) % GENOME_BP + 1).alias("pos"),
        F.when(k % 2 == 0, "A").otherwise("C").alias("ref"),
        F.when(k % 3 == 0, "G").otherwise("T").alias("alt"),
    ]


def markers(t: Tables) -> DataFrame:
    return t.part.select(*_marker_cols("p_partkey"))


_LINES = """(SELECT l.*, 'L' || c_nationkey || '_' || c_mktsegment AS sample FROM lineitem l
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


def _lines(t: Tables, *cols: str) -> DataFrame:
    """Order lines with the sample of their customer. Orders find theirs first, so the long table is dealt out once."""
    sample = F.concat(F.lit("L"), "c_nationkey", F.lit("_"), "c_mktsegment")
    of_order = t.orders.select("o_orderkey", "o_custkey").join(
        t.customer.select("c_custkey", sample.alias("sample")), F.col("o_custkey") == F.col("c_custkey")
    ).select("o_orderkey", "sample")
    return t.lineitem.select("l_orderkey", *cols).join(of_order, F.col("l_orderkey") == F.col("o_orderkey")).select("sample", *cols)


# Observed calls only (a sample without lines for a marker has no row here).
CALLS = f"""(SELECT 'M' || l_partkey AS marker, (l_partkey % 5 + 1)::INT AS chrom,
  (l_partkey * 7919) % {GENOME_BP} + 1 AS pos, sample, least(count(*), 2)::INT AS dosage
  FROM {_LINES} x GROUP BY l_partkey, sample)"""


def calls(t: Tables) -> DataFrame:
    per_pair = _lines(t, "l_partkey").groupBy("l_partkey", "sample").agg(F.count(F.lit(1)).alias("n"))
    m, c, p, *_ = _marker_cols("l_partkey")
    return per_pair.select(m, c, p, "sample", F.least("n", F.lit(2)).cast("int").alias("dosage"))


# Dosage of every marker in every sample: no line means reference homozygote.
DOSAGE = f"""(SELECT m.marker, m.chrom, m.pos, s.sample, coalesce(c.dosage, 0)::INT AS dosage
  FROM (SELECT DISTINCT marker, chrom, pos FROM {CALLS} a) m
  CROSS JOIN (SELECT DISTINCT sample FROM {_LINES} b) s
  LEFT JOIN {CALLS} c ON c.marker = m.marker AND c.sample = s.sample)"""


# ------------------------------------------------------------------ phenotypes per sample
PHENO = f"""(SELECT sample, trait || '_' || l_returnflag AS trait, avg(value) AS value FROM (
  SELECT sample, l_returnflag, unnest(['price','discount','tax','area']) AS trait,
    unnest([l_extendedprice, l_discount, l_tax, l_quantity]) AS value FROM {_LINES} x) y
  GROUP BY sample, trait, l_returnflag)"""


def phenotypes(t: Tables) -> DataFrame:
    wide = (
        _lines(t, "l_returnflag", "l_extendedprice", "l_discount", "l_tax", "l_quantity")
        .groupBy("sample", "l_returnflag")
        .agg(
            F.avg("l_extendedprice").alias("price"),
            F.avg("l_discount").alias("discount"),
            F.avg("l_tax").alias("tax"),
            F.avg("l_quantity").alias("area"),
        )
    )
    long = wide.unpivot(["sample", "l_returnflag"], ["price", "discount", "tax", "area"], "metric", "value")
    return long.select("sample", F.concat_ws("_", "metric", "l_returnflag").alias("trait"), "value")


# ------------------------------------------------------------------ association results
ASSOC = f"""(SELECT 'T' || (l_suppkey % 40) AS trait, 'M' || l_partkey AS marker, (l_partkey % 5 + 1)::INT AS chrom,
  (l_partkey * 7919) % {GENOME_BP} + 1 AS pos,
  min(((round(l_extendedprice * 100)::BIGINT * 7919) % 100003 + 1) / 100004.0::DOUBLE) AS p_value,
  round(avg(l_discount - l_tax), 6) AS effect
  FROM lineitem GROUP BY l_suppkey % 40, l_partkey)"""


def associations(t: Tables) -> DataFrame:
    p = ((F.round(F.col("l_extendedprice") * 100).cast("long") * 7919) % 100003 + 1) / F.lit(100004.0)
    m, c, pos, *_ = _marker_cols("l_partkey")
    per = (
        t.lineitem.select((F.col("l_suppkey") % 40).alias("s"), "l_partkey", p.alias("p"),
                          (F.col("l_discount") - F.col("l_tax")).alias("e"))
        .groupBy("s", "l_partkey")
        .agg(F.min("p").alias("p_value"), F.round(F.avg("e"), 6).alias("effect"))
    )
    return per.select(F.concat(F.lit("T"), "s").alias("trait"), m, c, pos, "p_value", "effect")


# ------------------------------------------------------------------ mask points and pixels
POINTS = """(SELECT l_suppkey AS image, l_quantity AS x, l_extendedprice / 1000 AS y,
  l_quantity * 5 AS r, 100 + l_discount * 1000 AS g, l_tax * 1000 AS b FROM lineitem)"""


def points(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_suppkey").alias("image"),
        F.col("l_quantity").alias("x"),
        (F.col("l_extendedprice") / 1000).alias("y"),
        (F.col("l_quantity") * 5).alias("r"),
        (100 + F.col("l_discount") * 1000).alias("g"),
        (F.col("l_tax") * 1000).alias("b"),
    )

"""The registered queries and their SQL equivalents, over the driver's tables.

Sequences are documents.text, one-to-many hits are lineitem per order, vectors are embeddings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from seqloom import storage
from seqloom.functions import sequences as S
from seqloom.operators import features, integrate, metrics, moments, spatial
from seqloom.sources import readers, sinks

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Stands for the published dipeptide weights, which are an input.
DIPEPTIDES = {"TH": 2.5, "HE": -1.25, "EN": 0.5, "DE": 24.68, "ON": -7.49}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Cleaning: the engines upper-case one letter differently (sharp s), so the SQL spells it out.
_CLEAN = "upper(replace(regexp_replace(text, '\\s+', '', 'g'), 'ß', 'SS'))"
_SEQ = f"SELECT doc_id, lang, {_CLEAN} AS seq, length({_CLEAN}) > {S.MAX_LENGTH} AS truncated FROM documents"


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole cleaned texts; truncated: whether an encoder would cut them."""
    seq = S.clean(F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", "lang", seq.alias("seq")).select("*", S.truncate(F.col("seq"))[1].alias("truncated")).where("seq <> ''")


@query(f"""
WITH s AS ({_SEQ}), v AS (SELECT lang, length(seq) AS n, truncated,
  (length(seq) - length(replace(replace(replace(seq, 'F', ''), 'W', ''), 'Y', '')))::DOUBLE / length(seq) AS arom,
  (length(seq) - length(replace(seq, 'E', '')))::DOUBLE / length(seq) AS e FROM s WHERE seq <> ''),
l AS (SELECT *, CASE WHEN arom > 0.04 OR NOT truncated AND n < 200 OR (e > 0.1 AND n > 1000) THEN 'yes' ELSE 'no' END AS label FROM v)
SELECT lang, label, count(*) AS n_rows, round(avg(n), 6) AS mean_length, round(stddev_pop(n), 6) AS std_length, round(avg(arom), 6) AS mean_arom FROM l GROUP BY lang, label
""")
def seq_label_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: clean, compose, label by a rule, and summarise; one scan and one shuffle."""
    seq = F.col("seq")
    v = _sequences(spark, sf_dir).select("lang", "truncated", F.length(seq).alias("n"), S.aromaticity(seq).alias("arom"), (S.count_of(seq, "E") / F.length(seq)).alias("e"))
    yes = (F.col("arom") > 0.04) | (~F.col("truncated") & (F.col("n") < 200)) | ((F.col("e") > 0.1) & (F.col("n") > 1000))
    return v.withColumn("label", F.when(yes, "yes").otherwise("no")).groupBy("lang", "label").agg(
        F.count("*").alias("n_rows"), F.round(F.avg("n"), 6).alias("mean_length"), F.round(F.stddev_pop("n"), 6).alias("std_length"), F.round(F.avg("arom"), 6).alias("mean_arom")
    )


@query(f"SELECT doc_id, CAST(length(substr(seq, 1, {S.MAX_LENGTH})) AS BIGINT) AS n, truncated FROM ({_SEQ}) WHERE seq <> ''")
def seq_clean_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an encoder takes: the first residues, and whether there were more."""
    seq, cut = S.truncate(F.col("seq"))
    return _sequences(spark, sf_dir).select("doc_id", F.length(seq).cast("long").alias("n"), cut.alias("truncated"))


_KD = "map([" + ", ".join(f"'{k}'" for k in S.HYDROPATHY) + "], [" + ", ".join(f"{v}::DOUBLE" for v in S.HYDROPATHY.values()) + "])"


@query(f"""
WITH s AS ({_SEQ})
SELECT doc_id, round((length(seq) - length(replace(replace(replace(seq, 'F', ''), 'W', ''), 'Y', '')))::DOUBLE / length(seq), 9) AS aromaticity,
  round(list_sum(list_transform(string_split(seq, ''), lambda c: coalesce({_KD}[c], 0.0::DOUBLE))) / length(seq), 6) AS gravy FROM s WHERE seq <> ''
""")
def seq_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.col("seq")
    return _sequences(spark, sf_dir).select("doc_id", F.round(S.aromaticity(seq), 9).alias("aromaticity"), F.round(S.gravy(seq), 6).alias("gravy"))


@query(f"""
WITH s AS ({_SEQ})
SELECT doc_id, CAST(length(seq) AS BIGINT) AS n, CAST(list_sum(list_transform(string_split(seq, ''), lambda c, k: k * CASE WHEN instr('{S.RESIDUES}', c) > 0 THEN instr('{S.RESIDUES}', c) ELSE 21 END)) AS BIGINT) AS checksum
FROM s WHERE seq <> ''
""")
def seq_tokenize_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.transform(S.tokens(F.col("seq")), lambda x, i: (i + 1) * x)
    return _sequences(spark, sf_dir).select("doc_id", F.length("seq").cast("long").alias("n"), F.aggregate(t, F.lit(0).cast("long"), lambda a, x: a + x).alias("checksum"))


@query(f"""
WITH s AS ({_SEQ}), p AS (SELECT unnest(string_split(seq, '')) AS c FROM s WHERE seq <> '')
SELECT count(*) AS n_positions, round(avg(coalesce({_KD}[c], 0.0::DOUBLE)), 6) AS mean_scale, round(stddev_pop(coalesce({_KD}[c], 0.0::DOUBLE)), 6) AS std_scale FROM p
""")
def residue_scale_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = moments.merge_rows(_sequences(spark, sf_dir).select(moments.folded(S.scale_values(F.col("seq"), S.HYDROPATHY)).alias("s")), ["s"])
    return one.select(F.col("s.n").alias("n_positions"), F.round(moments.mean_of(F.col("s")), 6).alias("mean_scale"), F.round(moments.deviation_of(F.col("s")), 6).alias("std_scale"))


_DI = "map([" + ", ".join(f"'{k}'" for k in DIPEPTIDES) + "], [" + ", ".join(f"{v}::DOUBLE" for v in DIPEPTIDES.values()) + "])"


@query(f"""
WITH s AS ({_SEQ})
SELECT doc_id, round(10.0::DOUBLE / len(l) * coalesce(list_sum(list_transform(list_zip(l[:-2], l[2:]), lambda p: coalesce({_DI}[p[1] || p[2]], 1.0::DOUBLE))), 0), 6) AS dipeptide_index FROM (SELECT doc_id, string_split(seq, '') AS l FROM s WHERE length(seq) > 1)
""")
def dipeptide_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sequences(spark, sf_dir).where("length(seq) > 1").select("doc_id", F.round(S.dipeptide_index(F.col("seq"), DIPEPTIDES), 6).alias("dipeptide_index"))


def _charge_sql() -> str:
    n = lambda r: f"(length(seq) - length(replace(seq, '{r}', '')))"
    up = lambda pk: f"1.0::DOUBLE / (pow(10.0::DOUBLE, 7.0::DOUBLE - {pk}::DOUBLE) + 1)"
    down = lambda pk: f"1.0::DOUBLE / (pow(10.0::DOUBLE, {pk}::DOUBLE - 7.0::DOUBLE) + 1)"
    out = f"{up(S.PK_N_TERM)} - {down(S.PK_C_TERM)}"
    out += "".join(f" + {n(r)} * {up(pk)}" for r, pk in S.PK_POSITIVE.items()) + "".join(f" - {n(r)} * {down(pk)}" for r, pk in S.PK_NEGATIVE.items())
    return out


@query(f"SELECT doc_id, round({_charge_sql()}, 6) AS charge FROM ({_SEQ}) WHERE seq <> ''")
def net_charge_closed_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sequences(spark, sf_dir).select("doc_id", F.round(S.net_charge(F.col("seq")), 6).alias("charge"))


def _count(r: str) -> str:
    return f"(length(seq) - length(replace(seq, '{r}', '')))"


def _charge_at(ph: str) -> str:
    """The charge at a pH, of the counts n_<residue> of a row."""
    up = lambda pk: f"1.0::DOUBLE / (pow(10.0::DOUBLE, {ph} - {pk}::DOUBLE) + 1)"
    down = lambda pk: f"1.0::DOUBLE / (pow(10.0::DOUBLE, {pk}::DOUBLE - {ph}) + 1)"
    out = f"{up(S.PK_N_TERM)} - {down(S.PK_C_TERM)}"
    return out + "".join(f" + n_{r} * {up(pk)}" for r, pk in S.PK_POSITIVE.items()) + "".join(f" - n_{r} * {down(pk)}" for r, pk in S.PK_NEGATIVE.items())


_MIDDLE = "(low + high) / 2"
# Properties of the standard letters of whole texts, 0 where there are none; the isoelectric point by 40 halvings.
_PROPERTIES = f"""
s AS MATERIALIZED (SELECT doc_id, regexp_replace({_CLEAN}, '[^{S.RESIDUES}]', '', 'g') AS seq FROM documents WHERE {_CLEAN} <> ''),
n AS MATERIALIZED (SELECT doc_id, seq, length(seq) AS length, {", ".join(f"{_count(r)} AS n_{r}" for r in S.RESIDUES)} FROM s),
halves(doc_id, step, low, high) AS (
  SELECT doc_id, 0, 0.0::DOUBLE, 14.0::DOUBLE FROM n
  UNION ALL SELECT doc_id, step + 1, CASE WHEN {_charge_at(_MIDDLE)} > 0 THEN {_MIDDLE} ELSE low END, CASE WHEN {_charge_at(_MIDDLE)} > 0 THEN high ELSE {_MIDDLE} END
  FROM halves JOIN n USING (doc_id) WHERE step < 40
),
letters AS (SELECT doc_id, string_split(seq, '') AS l FROM s WHERE length(seq) > 1),
pairs AS (SELECT doc_id, 10.0::DOUBLE / len(l) * list_sum(list_transform(list_zip(l[:-2], l[2:]), lambda p: coalesce({_DI}[p[1] || p[2]], 1.0::DOUBLE))) AS instability FROM letters),
known AS (SELECT doc_id, (n_F + n_W + n_Y)::DOUBLE / length AS aromaticity, {_charge_at("7.0::DOUBLE")} AS charge, ({" + ".join(f"n_{r} * {v}::DOUBLE" for r, v in S.HYDROPATHY.items())}) / length AS gravy,
  {" + ".join(f"n_{r} * {v}::DOUBLE" for r, v in S.MASS.items())} + {S.WATER}::DOUBLE AS weight, {_MIDDLE} AS point FROM n JOIN halves USING (doc_id) WHERE step = 40 AND length > 0),
properties AS MATERIALIZED (SELECT doc_id, seq, length, {", ".join(f"coalesce({c}, 0.0::DOUBLE) AS {c}" for c in ("aromaticity", "charge", "gravy", "instability", "point", "weight"))}
  FROM n LEFT JOIN known USING (doc_id) LEFT JOIN pairs USING (doc_id))"""


@query(f"""
WITH RECURSIVE {_PROPERTIES}
SELECT doc_id, round(aromaticity, 6) AS aromaticity, round(charge, 6) AS "charge_at_pH_7", round(gravy, 6) AS gravy, round(instability, 6) AS instability_index, round(point, 6) AS isoelectric_point, round(weight, 6) AS molecular_weight FROM properties
""")
def physicochemical_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six properties, the isoelectric point by bisection, of the standard letters of each whole sequence."""
    only = F.regexp_replace("seq", f"[^{S.RESIDUES}]", "")
    whole = _table(spark, sf_dir, "documents").select("doc_id", S.clean(F.col("text")).alias("seq")).where("seq <> ''")
    p = whole.select("doc_id", only.alias("seq")).select("doc_id", S.properties(F.col("seq"), DIPEPTIDES).alias("p"))
    return p.select("doc_id", *[F.round(F.col("p")[f], 6).alias(f) for f in ("aromaticity", "charge_at_pH_7", "gravy", "instability_index", "isoelectric_point", "molecular_weight")])


@query(r"""
SELECT c_custkey AS id, trim(string_split(c_name || ';x', ';')[1]) AS first_part, nullif(regexp_extract('NCBI_TaxID=' || c_custkey || ' x', 'NCBI_TaxID=(\d+)', 1), '') AS tax,
  string_split('sp|' || c_name || '|y', '|')[2] AS query_id, string_split(c_acctbal::VARCHAR, '.')[1] AS root,
  coalesce(nullif(substr(c_mktsegment, 1, 1), ''), '?') AS prefix FROM customer
""")
def id_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("c_name")
    return _table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), S.first_accession(F.concat(name, F.lit(";x"))).alias("first_part"),
        S.taxonomy_id(F.concat(F.lit("NCBI_TaxID="), F.col("c_custkey").cast("string"), F.lit(" x"))).alias("tax"),
        S.query_id(F.concat(F.lit("sp|"), name, F.lit("|y"))).alias("query_id"),
        S.accession_root(S.number_text(F.col("c_acctbal"))).alias("root"), S.prefix_key(F.col("c_mktsegment")).alias("prefix"),
    )


@query("""
SELECT l_returnflag AS flag, count(*) AS n_rows, count(CASE WHEN l_linenumber % 3 <> 0 THEN 1 END) AS n_finite,
  round(avg(CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END), 6) AS mean_finite, round(sum(CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity ELSE 0 END), 2) AS sum_imputed
FROM lineitem GROUP BY l_returnflag
""")
def finite_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NaN, infinite and unparsable values are skipped by statistics and 0 for features."""
    raw = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity").cast("string")).when(F.col("l_linenumber") == 3, "NaN").otherwise("n/a")
    li = _table(spark, sf_dir, "lineitem").select("l_returnflag", raw.alias("raw"))
    return li.groupBy(F.col("l_returnflag").alias("flag")).agg(
        F.count("*").alias("n_rows"), F.count(S.finite(F.col("raw"))).alias("n_finite"),
        F.round(F.avg(S.finite(F.col("raw"))), 6).alias("mean_finite"), F.round(F.sum(S.imputed(F.col("raw"))), 2).alias("sum_imputed"),
    )


def _order_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with a list of their line items (empty for none)."""
    li = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus")
    lists = integrate.as_lists(li, "o_orderkey", ["l_linenumber", "l_partkey"], "items")
    return integrate.left_lists(_table(spark, sf_dir, "orders"), lists, "o_orderkey", "items")


@query("""
WITH c AS (SELECT l_orderkey, bool_or(l_partkey % 97 IN (1, 2, 3)) AS d, bool_or(l_quantity > 49) AS q FROM lineitem GROUP BY 1),
l AS (SELECT o_orderpriority, CASE WHEN coalesce(d, false) OR coalesce(q, false) OR (o_totalprice > 400000 AND o_custkey % 2 = 0) THEN 'yes' ELSE 'no' END AS label FROM orders LEFT JOIN c ON o_orderkey = l_orderkey)
SELECT o_orderpriority AS priority, count(*) AS total, CAST(sum(CASE WHEN label = 'yes' THEN 1 ELSE 0 END) AS BIGINT) AS labelled_yes FROM l GROUP BY 1
""")
def label_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any child in a set, any child above a threshold, or two of the row's own values."""
    domains = F.transform("items", lambda i: F.struct(F.when((i["l_partkey"] % 97).isin(1, 2, 3), F.lit(integrate.LABEL_DOMAINS[0])).alias("accession")))
    structures = F.transform("items", lambda i: F.struct((i["l_quantity"] - 49 + integrate.SHEET_PERCENT).alias("sheet_percentage")))
    gravy = F.col("o_totalprice") - 400000 + integrate.GRAVY
    instability = F.when(F.col("o_custkey") % 2 == 0, integrate.INSTABILITY + 1).otherwise(0.0)
    out = _order_lists(spark, sf_dir).withColumn("label", integrate.label(domains, structures, gravy, instability))
    return out.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("total"), F.count_if(F.col("label") == "yes").alias("labelled_yes"))


@query("""
SELECT o_orderkey, count(l_orderkey) AS n_items, CAST(coalesce(sum(l_quantity), 0) AS DOUBLE) AS quantity,
  (SELECT min(l_partkey) FROM lineitem b WHERE b.l_orderkey = o_orderkey AND b.l_linenumber = (SELECT min(l_linenumber) FROM lineitem c WHERE c.l_orderkey = o_orderkey)) AS first_part
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey
""")
def nested_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left join to lists, first element, empty default."""
    return _order_lists(spark, sf_dir).select(
        "o_orderkey", F.size("items").cast("long").alias("n_items"),
        F.aggregate("items", F.lit(0.0), lambda s, i: s + i["l_quantity"]).alias("quantity"), F.get("items", F.lit(0))["l_partkey"].alias("first_part"),
    )


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_join_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return sinks.subset(docs, _table(spark, sf_dir, "labels"), "doc_id")


@query("""
WITH e AS (SELECT DISTINCT o_orderkey, unnest([o_custkey, o_custkey % 100, o_orderkey % 100]) AS id FROM orders)
SELECT id, count(*) AS n_orders FROM e GROUP BY id
""")
def explode_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").select("o_orderkey", F.array("o_custkey", F.col("o_custkey") % 100, F.col("o_orderkey") % 100).alias("ids"))
    return integrate.fan_out(o, "ids", "id").groupBy("id").agg(F.count("*").alias("n_orders"))


@query("""
SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda p: p[1] * p[2])), 6) AS product
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
""")
def zip_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two parallel lists joined by position."""
    e = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    pairs = F.arrays_zip("a", "b")
    return e.join(nxt, "vec_id").select("vec_id", F.round(F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["a"] * p["b"]), 6).alias("product"))


_STATS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("SELECT " + ", ".join(f"round(avg({c}), 4) AS {c}_mean, round(greatest(stddev_pop({c}), 1e-7), 4) AS {c}_std" for c in _STATS) + ", 5.0::DOUBLE AS constant_mean, 1e-7::DOUBLE AS constant_std FROM lineitem")
def feature_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem")
    values = [S.finite(F.col(c)) for c in _STATS] + [F.lit(5.0)]
    mean, std = features.moments(values)
    row = li.agg(mean.alias("m"), std.alias("s"))
    names = [*_STATS, "constant"]
    return row.select(*[F.round(F.get("m", F.lit(i)), 4).alias(f"{c}_mean") for i, c in enumerate(names)], *[(F.round(F.get("s", F.lit(i)), 4) if c != "constant" else F.get("s", F.lit(i))).alias(f"{c}_std") for i, c in enumerate(names)])


@query("""
WITH s AS (SELECT avg(l_quantity) AS m1, stddev_pop(l_quantity) AS s1, avg(l_discount) AS m2, stddev_pop(l_discount) AS s2 FROM lineitem)
SELECT l_returnflag AS flag, count(*) AS n_rows, round(avg((l_quantity - m1) / s1), 6) AS z_quantity, round(avg((l_discount - m2) / s2), 6) AS z_discount FROM lineitem, s GROUP BY 1
""")
def zscore_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_discount")
    mean, std = features.moments([F.col("l_quantity"), F.col("l_discount")])
    row = li.agg(mean.alias("m"), std.alias("s"))
    z = li.crossJoin(F.broadcast(row)).select("l_returnflag", features.zscore(F.array("l_quantity", "l_discount"), F.col("m"), F.col("s")).alias("z"))
    return z.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n_rows"), F.round(F.avg(F.get("z", F.lit(0))), 6).alias("z_quantity"), F.round(F.avg(F.get("z", F.lit(1))), 6).alias("z_discount"))


@query("""
SELECT o_orderkey, CAST(o_orderpriority IS NOT DISTINCT FROM '1-URGENT' AS INT) AS c0, CAST(o_orderpriority IS NOT DISTINCT FROM '2-HIGH' AS INT) AS c1, CAST(o_orderpriority IS NOT DISTINCT FROM '-' AS INT) AS c2 FROM orders
""")
def onehot_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = S.one_hot(F.col("o_orderpriority"), ("1-URGENT", "2-HIGH", "-"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", *[F.get(h, F.lit(i)).alias(f"c{i}") for i in range(3)])


@query("""
SELECT o_orderkey, coalesce(max(CASE WHEN l_returnflag = 'A' THEN 1.0::DOUBLE END), 0.0::DOUBLE) AS has_a, coalesce(max(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE END), 0.0::DOUBLE) AS has_r
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1
""")
def domain_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.transform("items", lambda i: F.struct(i["l_returnflag"].alias("accession")))
    flags = _order_lists(spark, sf_dir).select("o_orderkey", items.alias("domains"))
    return flags.select("o_orderkey", integrate.has_domain(F.col("domains"), "A").cast("double").alias("has_a"), integrate.has_domain(F.col("domains"), "R").cast("double").alias("has_r"))


@query("""
WITH m AS (SELECT o_orderkey, CASE WHEN l_returnflag = 'A' THEN 'H' WHEN l_returnflag = 'N' THEN 'E' WHEN l_returnflag IS NOT NULL THEN 'T' END AS k FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey)
SELECT o_orderkey, round(100.0::DOUBLE * count(CASE WHEN k = 'H' THEN 1 END) / nullif(count(k), 0), 6) AS helix, round(100.0::DOUBLE * count(CASE WHEN k = 'E' THEN 1 END) / nullif(count(k), 0), 6) AS sheet,
  round(100.0::DOUBLE * count(CASE WHEN k = 'T' THEN 1 END) / nullif(count(k), 0), 6) AS coil FROM m GROUP BY 1
""")
def class_percentages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.transform("items", lambda i: F.when(i["l_returnflag"] == "A", "H").when(i["l_returnflag"] == "N", "E").otherwise("T"))
    p = _order_lists(spark, sf_dir).select("o_orderkey", S.structure_percentages(kinds).alias("p"))
    return p.select("o_orderkey", *[F.round(F.col("p")[c], 6).alias(c) for c in ("helix", "sheet", "coil")])


@query("""
WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)
SELECT a.vec_id AS idx1, b.vec_id AS idx2 FROM p a JOIN p b ON a.vec_id < b.vec_id
WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 0.1::DOUBLE * 0.1::DOUBLE
""")
def contact_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda i: F.get("embedding", F.lit(i)).cast("double")
    p = _table(spark, sf_dir, "embeddings").select(F.lit("all").alias("structure_id"), F.col("vec_id").alias("index"), d(0).alias("x"), d(1).alias("y"), d(2).alias("z"))
    return spatial.range_pairs(p, 0.1).select("idx1", "idx2")


_COS = "1 - list_inner_product(a.u, b.u)"
_UNIT = "SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings"


@query(f"WITH n AS MATERIALIZED ({_UNIT}) SELECT a.vec_id AS a, b.vec_id AS b, round({_COS}, 6) AS distance FROM n a JOIN n b ON a.vec_id < b.vec_id WHERE {_COS} <= 0.6")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.similarity_pairs(_table(spark, sf_dir, "embeddings"), 0.6).select("a", "b", F.round("distance", 6).alias("distance"))


_DBSCAN = f"""
WITH RECURSIVE n AS MATERIALIZED ({_UNIT}),
e AS MATERIALIZED (SELECT a.vec_id AS i, b.vec_id AS j FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE {_COS} <= 0.65),
core AS MATERIALIZED (SELECT i FROM e GROUP BY i HAVING count(*) + 1 >= 3),
ce AS MATERIALIZED (SELECT i, j FROM e WHERE i IN (SELECT i FROM core) AND j IN (SELECT i FROM core)),
reach(i, root) AS (SELECT i, i FROM core UNION SELECT ce.j, reach.root FROM reach JOIN ce ON ce.i = reach.i),
comp AS MATERIALIZED (SELECT i, min(root) AS c FROM reach GROUP BY i),
border AS (SELECT e.i, min(comp.c) AS c FROM e JOIN comp ON comp.i = e.j GROUP BY e.i),
cl AS (SELECT n.vec_id AS id, coalesce(comp.c, border.c, -1) AS cluster FROM n LEFT JOIN comp ON comp.i = n.vec_id LEFT JOIN border ON border.i = n.vec_id)
"""


@query(_DBSCAN + "SELECT id, cluster FROM cl")
def dbscan_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.dbscan(_table(spark, sf_dir, "embeddings"), 0.65, 3)


@query(
    _DBSCAN
    + """, r AS (SELECT cluster, row_number() OVER (ORDER BY md5(cluster || '|42'), cluster) AS r, count(*) OVER () AS k FROM (SELECT DISTINCT cluster FROM cl WHERE cluster <> -1))
SELECT id, cl.cluster, CASE WHEN k > 1 AND r <= ceil(0.2 * k) THEN 'test' ELSE 'train' END AS split FROM cl JOIN r ON cl.cluster = r.cluster
"""
)
def cluster_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.cluster_split(spatial.dbscan(_table(spark, sf_dir, "embeddings"), 0.65, 3))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", ((F.length("text") % 97).cast("double") / 16 - 3).alias("z"))
    return docs.join(_table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("y")), "doc_id")


@query("""
WITH d AS (SELECT documents.doc_id AS i, (length(text) % 97)::DOUBLE / 16 - 3 AS z, quality::DOUBLE AS y FROM documents JOIN labels ON documents.doc_id = labels.doc_id),
p AS (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-z)) AS p, greatest(z, 0) - z * y + ln(1 + exp(-abs(z))) AS loss FROM d),
m AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS mr FROM p)
SELECT count(*) AS rows, round(avg(CASE WHEN (p > 0.5) = (y > 0.5) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy, round(avg(loss), 6) AS loss_by_row,
  (SELECT round(avg(b), 6) FROM (SELECT avg(loss) AS b FROM p GROUP BY i // 64)) AS loss_by_batch,
  round((sum(CASE WHEN y > 0 THEN mr END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM m
""")
def metric_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.evaluate(_scored(spark, sf_dir), "z", "y", "doc_id")
    return m.select("rows", *[F.round(c, 6).alias(c) for c in ("accuracy", "loss_by_row", "loss_by_batch", "auc")])


@query("""
WITH g AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber) - 1 AS i FROM lineitem)
SELECT CAST(i // 64 AS BIGINT) AS batch, count(*) AS n_rows, min(l_orderkey) AS first_order, round(sum(l_quantity), 2) AS quantity FROM g GROUP BY 1
""")
def global_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-size batches over a total order. The global number is the rows of earlier range partitions plus the place within one: no single task sorts all."""
    key = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    li = _table(spark, sf_dir, "lineitem").select(*key, "l_quantity")
    li = readers.numbered(li, key)
    return li.groupBy(F.floor(F.col("global_index") / 64).alias("batch")).agg(F.count("*").alias("n_rows"), F.min("l_orderkey").alias("first_order"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_returnflag, CAST(row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber) - 1 AS BIGINT) AS global_index FROM lineitem
""")
def numbered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its place in a total order, other columns kept."""
    key = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return readers.numbered(_table(spark, sf_dir, "lineitem"), key).select(*key, "l_quantity", "l_returnflag", "global_index")


@query(f"""
WITH s AS ({_SEQ}), b AS (SELECT doc_id, doc_id // 32 AS batch, length(seq) AS n FROM s WHERE seq <> '')
SELECT doc_id, CAST(batch AS BIGINT) AS batch, CAST(max(n) OVER (PARTITION BY batch) AS BIGINT) AS batch_length, CAST(max(n) OVER (PARTITION BY batch) - n AS BIGINT) AS padding FROM b
""")
def batch_pad_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = features.batches(_sequences(spark, sf_dir).select("doc_id", "seq"), "doc_id", 32, F.length("seq"))
    padded = features.repaired(S.tokens(F.col("seq")), F.col("batch_length"), F.lit(S.PAD))
    return b.select("doc_id", "batch", F.col("batch_length").cast("long").alias("batch_length"), F.size(F.filter(padded, lambda x: x == S.PAD)).cast("long").alias("padding"))


@query("SELECT coalesce(nullif(substr(p_name, 1, 1), ''), '?') AS prefix, count(*) AS n_rows, round(sum(p_retailprice), 2) AS price FROM part GROUP BY 1")
def partition_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written partitioned by the id's first character, and read back with string partitions."""
    part = _table(spark, sf_dir, "part").select(F.col("p_name").alias("id"), "p_retailprice")
    path = storage.folder(spark, "parts")
    schema = StructType([*part.schema.fields, StructField("id_prefix", StringType())])
    sinks.write_partitioned(part, path, schema, key="id", rows_per_task=5_000)
    return readers.read_dataset(spark, path).groupBy(F.col("id_prefix").alias("prefix")).agg(F.count("*").alias("n_rows"), F.round(F.sum("p_retailprice"), 2).alias("price"))


@query("SELECT vec_id::VARCHAR AS \"ID\", printf('%.6f', (vec_id % 1000) / 1024.0::DOUBLE + 0.0000001) AS \"Gelation_Probability\" FROM embeddings")
def prediction_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "embeddings").select("vec_id", ((F.col("vec_id") % 1000) / 1024.0 + 0.0000001).alias("probability"))
    return sinks.prediction_lines(p, "vec_id")


@query(f"SELECT '>sp|' || doc_id || '|Generated' || chr(10) || seq AS value FROM ({_SEQ}) WHERE seq <> ''")
def fasta_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sequences(spark, sf_dir).select(F.col("doc_id").cast("string").alias("uniprot_id"), F.col("seq").alias("sequence")).select(sinks.fasta_entry())


_RAW = ("length", "weight", "aromaticity", "instability", "point", "gravy", "charge", "helix", "sheet", "coil", "has_0", "has_1", "has_2")


@query(f"""
WITH RECURSIVE {_PROPERTIES},
hits AS (SELECT l_orderkey, {", ".join(f"bool_or(l_partkey % 4 = {i}) AS has_{i}" for i in range(3))} FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1),
shapes AS (SELECT l_orderkey, max(l_quantity) > {integrate.SHEET_PERCENT} AS much, arg_min(l_quantity, {{'id': l_suppkey::VARCHAR, 'q': l_quantity}}) AS first FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1),
raw AS MATERIALIZED (SELECT doc_id, length::DOUBLE AS length, weight, aromaticity, instability, point, gravy, charge,
  CASE WHEN first IS NOT NULL THEN 20.0::DOUBLE END AS helix, first::DOUBLE AS sheet, 80.0::DOUBLE - first AS coil, {", ".join(f"CASE WHEN coalesce(has_{i}, false) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS has_{i}" for i in range(3))},
  coalesce(has_0 OR has_1 OR has_2, false) OR coalesce(much, false) OR (gravy > {integrate.GRAVY} AND instability > {integrate.INSTABILITY}) AS yes
  FROM properties LEFT JOIN hits ON hits.l_orderkey = doc_id LEFT JOIN shapes ON shapes.l_orderkey = doc_id WHERE seq <> ''),
m AS (SELECT {", ".join(f"coalesce(avg({c}), 0.0::DOUBLE) AS m_{c}, greatest(coalesce(stddev_pop({c}), 0.0::DOUBLE), {features.STD_FLOOR}::DOUBLE) AS s_{c}" for c in _RAW)} FROM raw)
SELECT doc_id::VARCHAR AS uniprot_id, length::INTEGER AS n, length::INTEGER AS n_residues, CASE WHEN yes THEN 1.0::FLOAT ELSE 0.0::FLOAT END AS gelation,
  {", ".join(f"round(((coalesce({c}, 0.0::DOUBLE) - m_{c}) / s_{c})::FLOAT::DOUBLE, 4) AS p{i}" for i, c in enumerate(_RAW))} FROM raw, m
""")
def integrated_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain: documents as sequences, line items as hits, integrated, labelled, normalised, featurised."""
    table = integrated_table(spark, sf_dir)
    f = features.featurised(table, features.stats(table))
    sums = [F.round(F.get("protein_features", F.lit(i)).cast("double"), 4).alias(f"p{i}") for i in range(13)]
    return f.select("uniprot_id", F.size("sequence").alias("n"), F.size("residue_features").alias("n_residues"), "gelation", *sums)


@query()
def model_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The network's forward pass, with random weights of a fixed seed, over featurised rows."""
    table = integrated_table(spark, sf_dir)
    out = metrics.scored(table, features.stats(table), metrics.Network.random(0, embed=16, filters=16, protein=8))
    return out.select("uniprot_id", F.round("probability", 6).alias("probability"))


def integrated_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the integrated schema, without residue features, which letters say; an order's line items stand for domain hits (odd numbers) and structures (even ones)."""
    only = F.regexp_replace(F.upper("text"), f"[^{S.RESIDUES}]+", "")
    # Texts are spread first, as one file of a few groups of rows would keep few tasks busy.
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")
    proteins = documents.select(F.col("doc_id").cast("string").alias("uniprot_id"), only.alias("sequence"))
    proteins = proteins.select("uniprot_id", "sequence", F.length("sequence").cast("long").alias("sequence_length"), F.lit("Unknown").alias("organism"), F.lit(None).cast("string").alias("taxonomy_id"))
    li = _table(spark, sf_dir, "lineitem")
    name = F.element_at(F.array(*map(F.lit, integrate.LABEL_DOMAINS), F.lit("PF00001")), (F.col("l_partkey") % 4 + 1).cast("int"))
    hits = li.where("l_linenumber % 2 = 1").select(F.col("l_orderkey").cast("string").alias("uniprot_id"), name.alias("accession"), F.col("l_partkey").alias("start"))
    shape = F.struct(F.lit(None).cast("double").alias("relative_accessibility"), F.lit(-60.0).alias("phi"), F.lit(-45.0).alias("psi"), F.lit("H").alias("secondary_structure"))
    structures = li.where("l_linenumber % 2 = 0").select(
        F.col("l_orderkey").cast("string").alias("uniprot_id"), F.col("l_suppkey").cast("string").alias("pdb_id"), F.lit(20.0).alias("helix_percentage"),
        F.col("l_quantity").alias("sheet_percentage"), (F.lit(80.0) - F.col("l_quantity")).alias("coil_percentage"), F.array(shape, shape).alias("dssp_residue_details"),
    )
    # Statistics and features read what is cleaned, listed and counted once. Empty sequences go behind that, or texts would be cleaned for the filter too.
    proteins = storage.saved(proteins, "proteins")
    table = storage.saved(integrate.joined(proteins.where("sequence <> ''"), hits, structures, DIPEPTIDES), "integrated")
    storage.forget(proteins)
    return table

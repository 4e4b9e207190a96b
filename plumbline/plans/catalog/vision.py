"""Near duplicates, error slices, statistical tests and concept verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import bits
from ...functions.stats import normal_cdf
from ...operators import concepts as co
from ...operators import impact as im
from ...operators import inference as inf
from ...operators import neardup as nd
from .. import frames as fr
from ..registry import query, sql

HS, PR, PF, RT = fr.HASHES_SQL, fr.PREDICTIONS_SQL, fr.PROFILES_SQL, fr.RATINGS_SQL

# --- hashes -----------------------------------------------------------------------------------


@query("f_array_hash", sql(HS, "SELECT vec_id, hash FROM base_hash"))
def _(spark, d):
    e = fr.table(spark, d, "embeddings")
    return e.select("vec_id", bits.average_hash(F.col("embedding")).alias("hash"))


@query(
    "f_hash64",
    sql(
        "texts AS (SELECT doc_id, md5(text) AS h, CASE WHEN doc_id % 9 = 0 THEN 'zz' WHEN doc_id % 10 = 0 THEN '' ELSE left(md5(text), 1 + doc_id::INT % 16) END AS s FROM documents)",
        """SELECT doc_id, CAST(CASE WHEN ('0x' || right(h, 16))::UBIGINT >= 9223372036854775808 THEN ('0x' || right(h, 16))::UBIGINT::HUGEINT - 18446744073709551616
             ELSE ('0x' || right(h, 16))::UBIGINT::HUGEINT END AS BIGINT) AS hash,
             CAST(CASE WHEN v >= 9223372036854775808 THEN v - 18446744073709551616 ELSE v END AS BIGINT) AS short_hash
           FROM (SELECT *, CASE WHEN s <> 'zz' AND s <> '' THEN ('0x' || s)::UBIGINT::HUGEINT END AS v FROM texts)""",
    ),
)
def _(spark, d):
    doc = F.col("doc_id")
    h = F.md5(F.encode(F.col("text"), "UTF-8"))
    short = F.when(doc % 9 == 0, "zz").when(doc % 10 == 0, "").otherwise(F.left(h, (doc % 16 + 1).cast("int")))
    return fr.table(spark, d, "documents").select("doc_id", bits.hash64(h).alias("hash"), bits.hash64(short).alias("short_hash"))


@query(
    "f_hamming",
    sql(
        HS,
        """SELECT id, CASE WHEN id % 50 = 1 THEN 64 ELSE bit_count(xor(hash, (1000003 * id)::BIGINT)) END AS distance FROM hashes""",
        longs=["distance"],
    ),
)
def _(spark, d):
    other = F.when(F.col("id") % 50 != 1, F.col("id") * 1000003)
    return fr.hashes(spark, d).select("id", bits.hamming(F.col("hash"), other).alias("distance"))


@query(
    "f_array_stats",
    sql(
        "px AS (SELECT vec_id, [floor(abs(x::DOUBLE) * 1000) % 256 for x in embedding] AS v FROM embeddings)",
        """SELECT vec_id, list_avg(v) AS mean, list_stddev_pop(v) AS std, list_stddev_pop(v) / 255 AS rms_contrast,
             len([x for x in v if x >= 250]) / 64.0::DOUBLE AS clipped_share, len([x for x in v if x <= 5]) / 64.0::DOUBLE AS crushed_share FROM px""",
        ["mean", "std", "rms_contrast", "clipped_share", "crushed_share"],
    ),
)
def _(spark, d):
    pixels = F.transform("embedding", lambda x: (F.floor(F.abs(x.cast("double")) * 1000) % 256).cast("double"))
    return fr.table(spark, d, "embeddings").select("vec_id", bits.array_stats(pixels).alias("s")).select("vec_id", "s.*")


GROUPS = """
hg AS (SELECT hash, count(*) AS n FROM hashes GROUP BY 1),
hn AS (SELECT a.hash AS hash_a, b.hash AS hash_b, bit_count(xor(a.hash, b.hash))::BIGINT AS distance, a.n AS n_a, b.n AS n_b, a.n * b.n AS pairs
       FROM hg a JOIN hg b ON a.hash < b.hash AND bit_count(xor(a.hash, b.hash)) <= 6
       UNION ALL SELECT hash, hash, 0, n, n, n * (n - 1) // 2 FROM hg WHERE n > 1),
sg AS (SELECT hash, split, min(id) AS id, max(id) AS last_id, count(*) AS n FROM hashes GROUP BY 1, 2),
sp AS (SELECT a.hash AS ha, b.hash AS hb, a.split AS sa, b.split AS sb, a.id AS ia, b.id AS ib, a.last_id, a.n AS na, b.n AS nb,
              bit_count(xor(a.hash, b.hash))::BIGINT AS distance, a.hash = b.hash AND a.split = b.split AS own
       FROM sg a JOIN sg b ON bit_count(xor(a.hash, b.hash)) <= 6 AND (a.hash < b.hash OR a.hash = b.hash AND (a.split < b.split OR a.split = b.split AND a.n > 1))),
ndp AS (SELECT CASE WHEN ia > ib THEN ib ELSE ia END AS a, CASE WHEN own THEN last_id WHEN ia > ib THEN ia ELSE ib END AS b,
               CASE WHEN ia > ib THEN sb ELSE sa END AS split_a, CASE WHEN ia > ib THEN sa ELSE sb END AS split_b, distance,
               (sa = 'train' AND sb IN ('val', 'production', 'test')) OR (sb = 'train' AND sa IN ('val', 'production', 'test')) AS "cross",
               CASE WHEN own THEN na * (na - 1) // 2 ELSE na * nb END AS pairs,
               CASE WHEN ia > ib THEN hb ELSE ha END AS hash_a, CASE WHEN ia > ib THEN ha ELSE hb END AS hash_b FROM sp),
lk AS (SELECT DISTINCT h.id FROM hashes h JOIN hashes t ON t.split = 'train' AND h.split IN ('val', 'production', 'test') AND bit_count(xor(h.hash, t.hash)) <= 6)"""


@query("j_hamming_neighbors", sql(HS + "," + GROUPS, "SELECT * FROM hn"))
def _(spark, d):
    return nd.hamming_neighbors(fr.hashes(spark, d), 6)


PAIR_COLS = ("a", "b", "split_a", "split_b", "distance", "cross", "pairs")


@query("near_dup_pairs", sql(HS + "," + GROUPS, 'SELECT a, b, split_a, split_b, distance, "cross", pairs FROM ndp'))
def _(spark, d):
    return nd.near_dup_pairs(fr.hashes(spark, d), 6).select(*PAIR_COLS)


@query("order_pairs", sql(HS + "," + GROUPS, 'SELECT a, b, split_a, split_b, distance, "cross", pairs FROM ndp ORDER BY "cross" DESC, distance, a, b'))
def _(spark, d):
    return nd.order_pairs(nd.near_dup_pairs(fr.hashes(spark, d), 6)).select(*PAIR_COLS)


def _leaked(spark, d):
    return nd.leaked_ids(fr.hashes(spark, d), 6)


@query("leaked_ids", sql(HS + "," + GROUPS, "SELECT id FROM lk"))
def _(spark, d):
    return _leaked(spark, d)


def wilson_sql(k: str, n: str) -> tuple[str, str]:
    z2 = "3.8414588206941254"
    center = f"(({k})::DOUBLE / ({n}) + {z2} / (2 * ({n}))) / (1 + {z2} / ({n}))"
    radius = f"(1.959963984540054 / (1 + {z2} / ({n}))) * sqrt(({k})::DOUBLE / ({n}) * (1 - ({k})::DOUBLE / ({n})) / ({n}) + {z2} / (4.0::DOUBLE * ({n}) * ({n})))"
    low = f"CASE WHEN ({n}) = 0 OR ({k}) = 0 THEN 0.0::DOUBLE ELSE greatest(0, {center} - {radius}) END"
    high = f"CASE WHEN ({n}) = 0 THEN 0.0::DOUBLE WHEN ({k}) = ({n}) THEN 1.0::DOUBLE ELSE least(1, {center} + {radius}) END"
    return low, high


def newcombe_ctes(src: str, keys: str = "") -> str:
    """p1, p2 and the interval of their difference from (k1, n1, k2, n2) of ``src``, as CTE nc."""
    l1, u1 = wilson_sql("k1", "n1")
    l2, u2 = wilson_sql("k2", "n2")
    return f"""
wl AS (SELECT *, CASE WHEN n1 > 0 THEN k1::DOUBLE / n1 ELSE 0 END AS p1, CASE WHEN n2 > 0 THEN k2::DOUBLE / n2 ELSE 0 END AS p2,
         {l1} AS l1, {u1} AS u1, {l2} AS l2, {u2} AS u2 FROM {src}),
nc AS (SELECT *, p1 - p2 AS diff, p1 - p2 - sqrt(power(p1 - l1, 2) + power(u2 - p2, 2)) AS diff_low,
         p1 - p2 + sqrt(power(u1 - p1, 2) + power(p2 - l2, 2)) AS diff_high FROM wl)"""


GAP = (
    PR + "," + GROUPS + """,
gapc AS (SELECT count(*) FILTER (lkd AND y_true = y_pred) AS k1, count(*) FILTER (lkd) AS n1, count(*) FILTER (NOT lkd AND y_true = y_pred) AS k2, count(*) FILTER (NOT lkd) AS n2
         FROM (SELECT *, id IN (SELECT id FROM lk) AS lkd FROM preds WHERE split IN ('val', 'production', 'test')))""" + "," + newcombe_ctes("gapc")
    + """, gap AS (SELECT n1 AS n_leaked, n2 AS n_clean, p1 AS acc_leaked, p2 AS acc_clean, diff AS gap, diff_low AS gap_low, diff_high AS gap_high,
      CASE WHEN n1 = 0 THEN 'none' WHEN n1::DOUBLE / (n1 + n2) > 0.1 OR (diff > 0.15 AND n1 >= 10) THEN 'critical'
           WHEN n1::DOUBLE / (n1 + n2) > 0.03 OR diff > 0.08 THEN 'moderate' ELSE 'low' END AS severity FROM nc)"""
)


def _gap(spark, d):
    return nd.leak_accuracy_gap(fr.predictions(spark, d), _leaked(spark, d))


@query("leak_accuracy_gap", sql(GAP, "SELECT * FROM gap", ["acc_leaked", "acc_clean", "gap", "gap_low", "gap_high"]))
def _(spark, d):
    return _gap(spark, d)


@query("leak_severity", sql(GAP, "SELECT severity FROM gap"))
def _(spark, d):
    return _gap(spark, d).select("severity")


# --- slices -----------------------------------------------------------------------------------


@query(
    "p_confusion_flag",
    sql(PR, "SELECT id, y_true <> y_pred AS is_error, y_true = 1 AS is_minority FROM preds"),
)
def _(spark, d):
    return co.confusion_flags(fr.predictions(spark, d)).select("id", "is_error", "is_minority")


@query(
    "p_high_conf_error",
    sql(PR, "SELECT id, y_probability FROM preds WHERE y_true <> y_pred AND (y_probability > 0.85 OR y_probability < 0.15)", ["y_probability"]),
)
def _(spark, d):
    return co.high_confidence_error(fr.predictions(spark, d)).select("id", "y_probability")


WL, WH = wilson_sql("errors", "n")
CAT_SLICES = """
overall AS (SELECT avg(CASE WHEN y_true <> y_pred THEN 1.0::DOUBLE ELSE 0 END) AS rate FROM preds),
vc AS (SELECT unnest(['site', 'device', 'split', 'annotator', 'meta:has_ruler']) AS dimension, unnest([site, device, split, annotator, has_ruler]) AS value, y_true, y_pred FROM preds),
vg AS (SELECT dimension, value, count(*) AS n, count(*) FILTER (y_true <> y_pred) AS errors, count(*) FILTER (y_true = 1) AS mn, count(*) FILTER (y_true = 1 AND y_pred = 1) AS mh
       FROM vc WHERE value IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 10)"""


def scored_sql(src: str) -> str:
    return f"""SELECT dimension, value, n, errors, errors::DOUBLE / n AS error_rate, {WL} AS low, {WH} AS high, errors::DOUBLE / n - rate AS excess,
      greatest(0, errors::DOUBLE / n - rate) * n AS impact, CASE WHEN mn > 0 THEN mh::DOUBLE / mn END AS minority_recall FROM {src}, overall"""


SLICE_DOUBLES = ["error_rate", "low", "high", "excess", "impact", "minority_recall"]
QUANT = """
feat AS (SELECT id, unnest(['sharpness', 'mean_luminance', 'jpeg_quality']) AS feature, unnest([5, 5, 4]) AS k, unnest([sharpness, mean_luminance, jpeg_quality]) AS v FROM profiles),
fr_ AS (SELECT feature, k, v, row_number() OVER (PARTITION BY feature ORDER BY v) - 1 AS r, count(*) OVER (PARTITION BY feature) AS n FROM feat),
fcut AS (SELECT feature, i, v AS cut FROM fr_, range(1, 5) t(i) WHERE i < k AND r = (i * n) // k),
placed AS (SELECT f.feature, (SELECT count(*) FROM fcut c WHERE c.feature = f.feature AND c.cut < f.v) AS bin, p.y_true, p.y_pred FROM feat f JOIN preds p ON f.id = p.id),
lab AS (SELECT p.*, lo.cut AS lo, hi.cut AS hi FROM placed p LEFT JOIN fcut lo ON lo.feature = p.feature AND lo.i = p.bin LEFT JOIN fcut hi ON hi.feature = p.feature AND hi.i = p.bin + 1),
qg AS (SELECT 'feature:' || feature AS dimension,
         CASE WHEN hi IS NULL THEN format('{} [> {:.2f}]', feature, lo) WHEN lo IS NULL THEN format('{} [min to {:.2f}]', feature, hi) ELSE format('{} [{:.2f} to {:.2f}]', feature, lo, hi) END AS value,
         count(*) AS n, count(*) FILTER (y_true <> y_pred) AS errors, count(*) FILTER (y_true = 1) AS mn, count(*) FILTER (y_true = 1 AND y_pred = 1) AS mh
       FROM lab GROUP BY feature, bin, lo, hi HAVING count(*) >= 10)"""
QF = {"sharpness": 5, "mean_luminance": 5, "jpeg_quality": 4}


@query("vision_slices", sql(PR + "," + CAT_SLICES, scored_sql("vg"), SLICE_DOUBLES))
def _(spark, d):
    return im.vision_slices(fr.predictions(spark, d))


@query("quantile_slices", sql(PR + "," + PF + "," + CAT_SLICES + "," + QUANT, scored_sql("qg"), SLICE_DOUBLES))
def _(spark, d):
    return im.quantile_slices(fr.predictions(spark, d), fr.profiles(spark, d), QF)


def _all_slices(spark, d):
    preds = fr.predictions(spark, d)
    return im.union_dimensions(im.vision_slices(preds), im.quantile_slices(preds, fr.profiles(spark, d), QF))


@query(
    "union_dimensions",
    sql(PR + "," + PF + "," + CAT_SLICES + "," + QUANT, scored_sql("(SELECT * FROM vg UNION ALL SELECT * FROM qg)"), SLICE_DOUBLES),
)
def _(spark, d):
    return _all_slices(spark, d)


@query(
    "rank_slices",
    sql(
        PR + "," + PF + "," + CAT_SLICES + "," + QUANT,
        f"SELECT * FROM ({scored_sql('(SELECT * FROM vg UNION ALL SELECT * FROM qg)')}) ORDER BY impact DESC, dimension, value LIMIT 5",
        SLICE_DOUBLES,
    ),
)
def _(spark, d):
    return im.rank_slices(_all_slices(spark, d), 5)


@query(
    "j_pred_profile",
    sql(PR + "," + PF, "SELECT p.id, p.split, f.sharpness, f.jpeg_quality FROM preds p LEFT JOIN profiles f ON p.id = f.id", ["sharpness", "jpeg_quality"]),
)
def _(spark, d):
    return im.profile_join(fr.predictions(spark, d), fr.profiles(spark, d)).select("id", "split", "sharpness", "jpeg_quality")


@query(
    "mean_profile",
    sql(PF, "SELECT avg(sharpness) AS sharpness, avg(colorfulness) AS colorfulness, avg(rms_contrast) AS rms_contrast, round(avg(jpeg_quality)) AS jpeg_quality FROM profiles",
        ["sharpness", "colorfulness", "rms_contrast", "jpeg_quality"]),
)
def _(spark, d):
    return im.mean_profile(fr.profiles(spark, d))


# --- tests on counts ----------------------------------------------------------------------------

# Late items of each supplier against those of its nation's other suppliers: real 2 x 2 tables.
COUNTS = """
bysup AS (SELECT l_suppkey, count(*) FILTER (l_discount >= 0.1) AS k1, count(*) AS n1 FROM lineitem GROUP BY 1),
tables AS (SELECT l_suppkey, k1, n1, k2, n2 FROM bysup, LATERAL (SELECT count(*) FILTER (l_tax >= 0.08 AND l_linenumber = 1) AS k2, count(*) FILTER (l_linenumber = 1) AS n2 FROM lineitem x WHERE x.l_suppkey = bysup.l_suppkey) y)"""


def _tables(spark, d):
    li = fr.table(spark, d, "lineitem")
    first = F.col("l_linenumber") == 1
    return li.groupBy("l_suppkey").agg(
        F.count_if(F.col("l_discount") >= 0.1).alias("k1"),
        F.count(F.lit(1)).alias("n1"),
        F.count_if(first & (F.col("l_tax") >= 0.08)).alias("k2"),
        F.count_if(first).alias("n2"),
    )


SMALL = """
small AS (SELECT o_custkey, count(*) FILTER (o_orderpriority = '1-URGENT') AS k1, count(*) AS n1, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 250000) AS k2,
                 count(*) FILTER (o_orderstatus = 'F') AS n2 FROM orders GROUP BY 1)"""


def _small(spark, d):
    o = fr.table(spark, d, "orders")
    done = F.col("o_orderstatus") == "F"
    return o.groupBy("o_custkey").agg(
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("k1"),
        F.count(F.lit(1)).alias("n1"),
        F.count_if(done & (F.col("o_totalprice") > 250000)).alias("k2"),
        F.count_if(done).alias("n2"),
    )


def choose(n: str, k: str) -> str:
    return f"(lgamma(({n}) + 1.0) - lgamma(({k}) + 1.0) - lgamma(({n}) - ({k}) + 1.0))"


def fisher_ctes(src: str, key: str) -> str:
    logp = f"{choose('k1 + k2', 'x')} + {choose('n1 + n2 - k1 - k2', 'n1 - x')} - {choose('n1 + n2', 'n1')}"
    return f"""
hyper AS (SELECT {key}, {logp} AS lp, {logp.replace('x)', 'k1)').replace(' x ', ' k1 ').replace('(x', '(k1').replace('- (x', '- (k1').replace('n1 - x', 'n1 - k1')} AS seen
          FROM {src}, LATERAL (SELECT unnest(range(greatest(0, n1 - (n1 + n2 - k1 - k2)), least(n1, k1 + k2) + 1)) AS x) xs),
fp AS (SELECT {key}, least(1.0, sum(CASE WHEN lp <= seen + 1e-9 THEN exp(lp) ELSE 0 END)) AS p FROM hyper GROUP BY 1)"""


@query("wilson_ci", sql(SMALL, f"SELECT o_custkey, k1 AS k, n1 AS n, {wilson_sql('k1', 'n1')[0]} AS low, {wilson_sql('k1', 'n1')[1]} AS high FROM small", ["low", "high"]))
def _(spark, d):
    return inf.wilson_ci(_small(spark, d).select("o_custkey", F.col("k1").alias("k"), F.col("n1").alias("n")))


@query("fisher_exact", sql(SMALL + "," + fisher_ctes("small", "o_custkey"), "SELECT s.*, f.p FROM small s JOIN fp f USING (o_custkey)", ["p"]))
def _(spark, d):
    return inf.fisher_exact(_small(spark, d))


def cdf_sql(x: str) -> str:
    t = f"(1 / (1 + 0.3275911 * abs({x}) / sqrt(2)))"
    poly = f"(((((1.061405429 * {t} + -1.453152027) * {t}) + 1.421413741) * {t} + -0.284496736) * {t} + 0.254829592) * {t}"
    tail = f"{poly} * exp(-({x}) * ({x}) / 2)"
    return f"CASE WHEN ({x}) < 0 THEN 0.5 * ({tail}) ELSE 1 - 0.5 * ({tail}) END"


@query("normal_cdf", sql("", f"SELECT c_custkey, {cdf_sql('(c_acctbal / 2000.0::DOUBLE - 2)')} AS value FROM customer", ["value"]))
def _(spark, d):
    return fr.table(spark, d, "customer").select("c_custkey", normal_cdf(F.col("c_acctbal") / F.lit(2000.0) - 2).alias("value"))


def two_prop_ctes(src: str, key: str, floor: int = 25) -> str:
    z = "(diff / nullif(sqrt((k1 + k2)::DOUBLE / (n1 + n2) * (1 - (k1 + k2)::DOUBLE / (n1 + n2)) * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n2)), 0))"
    return (
        newcombe_ctes(src)
        + ","
        + fisher_ctes(src, key)
        + f""",
zt AS (SELECT nc.*, fp.p AS exact, least(k1, n1 - k1, k2, n2 - k2) < 5 AS small,
         CASE WHEN least(k1, n1 - k1, k2, n2 - k2) < 5 THEN 0 ELSE coalesce({z}, 0) END AS z FROM nc JOIN fp USING ({key})),
tp2 AS (SELECT {key}, k1, n1, k2, n2, p1, p2, diff, diff_low, diff_high, z, CASE WHEN small THEN exact ELSE 2 * (1 - ({cdf_sql('abs(z)')})) END AS p,
         CASE WHEN p2 > 0 THEN p1 / p2 WHEN p1 = 0 THEN 1 END AS risk_ratio, p2 = 0 AND p1 > 0 AS rr_infinite,
         CASE WHEN small THEN 'fisher_exact' ELSE 'z_test' END AS test, n1 < {floor} OR n2 < {floor} AS underpowered FROM zt)"""
    )


TWO_DOUBLES = ["p1", "p2", "diff", "diff_low", "diff_high", "z", "p", "risk_ratio"]


@query("two_proportion", sql(COUNTS + "," + two_prop_ctes("tables", "l_suppkey"), "SELECT * FROM tp2", TWO_DOUBLES))
def _(spark, d):
    return inf.two_proportion(_tables(spark, d))


PVALS = """
pv AS (SELECT o_orderkey, o_custkey % 40 AS investigation, ((o_orderkey * 7919) % 997) / 997.0::DOUBLE AS p FROM orders),
pr AS (SELECT *, rank() OVER (PARTITION BY investigation ORDER BY p DESC) AS down, count(*) OVER (PARTITION BY investigation) AS m FROM pv),
ps AS (SELECT *, least(1.0, p * m / (m - down + 1)) AS step FROM pr),
adj AS (SELECT o_orderkey, investigation, p, min(step) OVER (PARTITION BY investigation ORDER BY p DESC) AS p_adjusted FROM ps)"""


def _pvals(spark, d):
    return fr.table(spark, d, "orders").select(
        "o_orderkey",
        (F.col("o_custkey") % 40).alias("investigation"),
        (((F.col("o_orderkey") * 7919) % 997).cast("double") / F.lit(997.0)).alias("p"),
    )


@query("bh_adjust", sql(PVALS, "SELECT * FROM adj", ["p", "p_adjusted"]))
def _(spark, d):
    return inf.bh_adjust(_pvals(spark, d), ("investigation",))


@query(
    "bh_cummin",
    sql(
        "",
        "SELECT o_orderkey, min(o_totalprice) OVER (ORDER BY o_orderkey DESC) AS running_min FROM orders",
        ["running_min"],
    ),
)
def _(spark, d):
    o = fr.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return inf.bh_cummin(o, (), "o_orderkey", "o_totalprice").select("o_orderkey", "running_min")


KAPPA = """
agree AS (SELECT concept_id, count(*) FILTER (r1 = 1 AND r2 = 1) AS a, count(*) FILTER (r1 = 1 AND r2 <> 1) AS b, count(*) FILTER (r1 <> 1 AND r2 = 1) AS c,
                 count(*) FILTER (r1 <> 1 AND r2 <> 1) AS dd, count(*) AS n FROM ratings GROUP BY 1),
kap AS (SELECT concept_id, n, CASE WHEN pe >= 1 THEN 1 ELSE (po - pe) / (1 - pe) END AS kappa
        FROM (SELECT *, (a + dd)::DOUBLE / n AS po, (a + b)::DOUBLE / n * (a + c) / n + (1 - (a + b)::DOUBLE / n) * (1 - (a + c)::DOUBLE / n) AS pe FROM agree))"""


@query("cohen_kappa", sql(RT + "," + KAPPA, "SELECT * FROM kap", ["kappa"]))
def _(spark, d):
    return inf.cohen_kappa(fr.ratings(spark, d), by=("concept_id",))


# --- concepts -------------------------------------------------------------------------------------

DISCOVERY = """
pool AS (SELECT * FROM preds WHERE split IN ('train', 'val')),
cat AS (SELECT id, 'false_negative' AS category, y_probability AS bad FROM pool WHERE y_true = 1 AND y_pred = 0
        UNION ALL SELECT id, 'false_positive', -y_probability FROM pool WHERE y_true = 0 AND y_pred = 1
        UNION ALL SELECT id, 'confident_error', 0 FROM pool WHERE y_true <> y_pred AND (y_probability > 0.85 OR y_probability < 0.15)
        UNION ALL SELECT id, 'true_positive', 0 FROM pool WHERE y_true = 1 AND y_pred = 1
        UNION ALL SELECT id, 'true_negative', 0 FROM pool WHERE y_true = 0 AND y_pred = 0),
picks AS (SELECT id, category, rank FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY bad, id) AS rank FROM cat)
          WHERE rank <= CASE WHEN category LIKE 'true%' THEN 5 ELSE 10 END)"""


def _picks(spark, d):
    return co.topk_discovery(fr.predictions(spark, d), 10)


@query("topk_discovery", sql(PR + "," + DISCOVERY, "SELECT * FROM picks"))
def _(spark, d):
    return _picks(spark, d)


@query("discovery_union", sql(PR + "," + DISCOVERY, "SELECT DISTINCT id FROM picks"))
def _(spark, d):
    return co.discovery_union(_picks(spark, d))


@query("j_discovery_exclude", sql(PR + "," + DISCOVERY, "SELECT id, split FROM preds WHERE id NOT IN (SELECT id FROM picks)"))
def _(spark, d):
    return co.held_out(fr.predictions(spark, d), co.discovery_union(_picks(spark, d))).select("id", "split")


@query(
    "disjoint_check",
    sql(PR + "," + DISCOVERY, "SELECT true AS disjoint, (SELECT count(DISTINCT id) FROM picks) AS discovered, (SELECT count(*) FROM preds WHERE id NOT IN (SELECT id FROM picks)) AS held_out"),
)
def _(spark, d):
    found = co.discovery_union(_picks(spark, d))
    rest = co.held_out(fr.predictions(spark, d), found)
    both = found.intersect(rest.select("id")).agg((F.count(F.lit(1)) == 0).alias("disjoint"))
    n = lambda df: df.agg(F.count(F.lit(1))).scalar()
    return both.select("disjoint", n(found).alias("discovered"), n(rest).alias("held_out"))


LABELS = """
clabels AS (SELECT id, 'ruler' AS concept_id, CASE WHEN id % 23 = 4 THEN 'uncertain' ELSE has_ruler END AS lab FROM preds WHERE id % 29 <> 3
            UNION ALL SELECT id, 'site_zero', CASE WHEN site = 'site0' THEN '1' ELSE '0' END FROM preds
            UNION ALL SELECT id, 'rare', CASE WHEN id % 97 = 0 THEN '1' ELSE '0' END FROM preds),
lrows AS (SELECT p.id, c.concept_id, c.lab::INT AS lab, p.site, p.split, p.y_true <> p.y_pred AS is_error
          FROM preds p JOIN clabels c ON p.id = c.id WHERE c.lab IN ('0', '1') AND p.id NOT IN (SELECT id FROM picks))"""


def _labels(spark, d):
    p = fr.predictions(spark, d)
    key = F.col("id")
    cells = F.array(
        F.when(key % 29 != 3, F.struct(F.lit("ruler").alias("concept_id"), F.when(key % 23 == 4, "uncertain").otherwise(F.col("metadata")["has_ruler"]).alias("label"))),
        F.struct(F.lit("site_zero").alias("concept_id"), F.when(F.col("site") == "site0", "1").otherwise("0").alias("label")),
        F.struct(F.lit("rare").alias("concept_id"), F.when(key % 97 == 0, "1").otherwise("0").alias("label")),
    )
    return p.select("id", F.inline(F.array_compact(cells)))


def _labelled(spark, d):
    preds = fr.predictions(spark, d)
    return co.labelled_rows(co.held_out(preds, co.discovery_union(co.topk_discovery(preds, 10))), _labels(spark, d))


@query("j_pred_label", sql(PR + "," + DISCOVERY + "," + LABELS, "SELECT id, concept_id, lab::BIGINT AS label, is_error FROM lrows"))
def _(spark, d):
    return _labelled(spark, d).select("id", "concept_id", "label", "is_error")


EFFECTS = """
strat AS (SELECT concept_id || '|' || site AS key, concept_id, site, count(*) FILTER (lab = 1 AND is_error) AS k1, count(*) FILTER (lab = 1) AS n1,
                 count(*) FILTER (lab = 0 AND is_error) AS k2, count(*) FILTER (lab = 0) AS n2 FROM lrows GROUP BY ALL HAVING count(*) FILTER (lab = 1) >= 5 AND count(*) FILTER (lab = 0) >= 5),
surv AS (SELECT concept_id, count(*) AS strata, count(*) FILTER (k1::DOUBLE / n1 > k2::DOUBLE / n2) AS consistent,
                count(*) FILTER (k1::DOUBLE / n1 > k2::DOUBLE / n2)::DOUBLE / count(*) >= 0.7 AS survives FROM strat GROUP BY 1)"""


@query("stratified_effect", sql(PR + "," + DISCOVERY + "," + LABELS + "," + EFFECTS, "SELECT * FROM surv"))
def _(spark, d):
    return inf.stratified_effect(_labelled(spark, d))


AUDIT = """
audit AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'ruler' WHEN 1 THEN 'site_zero' ELSE 'rare' END AS concept_id, r1, r2 FROM ratings)"""


def _audit(spark, d):
    k = F.col("doc_id") % 3
    name = F.when(k == 0, "ruler").when(k == 1, "site_zero").otherwise("rare")
    # Second readings disagree too often overall; the ruler labels are re-read without error.
    return fr.ratings(spark, d).select(name.alias("concept_id"), "r1", F.when(k == 0, F.col("r1")).otherwise(F.col("r2")).alias("r2"))


VERDICT = (
    PR + "," + DISCOVERY + "," + LABELS + "," + EFFECTS + "," + RT.strip() + """,
audit AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'ruler' WHEN 1 THEN 'site_zero' ELSE 'rare' END AS concept_id, r1, CASE WHEN doc_id % 3 = 0 THEN r1 ELSE r2 END AS r2 FROM ratings),
""" + KAPPA.replace("FROM ratings", "FROM audit").strip() + """,
eff AS (SELECT concept_id, count(*) FILTER (lab = 1 AND is_error) AS k1, count(*) FILTER (lab = 1) AS n1, count(*) FILTER (lab = 0 AND is_error) AS k2, count(*) FILTER (lab = 0) AS n2 FROM lrows GROUP BY 1),
""" + two_prop_ctes("eff", "concept_id").strip() + """,
bhp AS (SELECT *, min(least(1.0, p * m / r)) OVER (ORDER BY p DESC) AS p_adjusted FROM (SELECT *, count(*) OVER () AS m, count(*) OVER (ORDER BY p) AS r FROM tp2)),
verdicts AS (SELECT b.concept_id, CASE WHEN k.kappa < 0.6 THEN 'unreliable_labelling' WHEN n1 < 25 OR n2 < 25 THEN 'underpowered'
    WHEN p_adjusted < 0.05 AND diff > 0 AND coalesce(survives, false) THEN 'supported' WHEN p_adjusted < 0.05 AND diff > 0 THEN 'weakened' WHEN diff <= 0 THEN 'rejected' ELSE 'weakened' END AS verdict,
    n1, n2, p1, p2, diff * 100 AS difference_pp, diff_low * 100 AS low_pp, diff_high * 100 AS high_pp, risk_ratio, p, p_adjusted, coalesce(k.kappa, 1) AS kappa, coalesce(survives, false) AS survives
  FROM bhp b LEFT JOIN kap k USING (concept_id) LEFT JOIN surv s USING (concept_id))"""
)
VERDICT_DOUBLES = ["p1", "p2", "difference_pp", "low_pp", "high_pp", "risk_ratio", "p", "p_adjusted", "kappa"]


def _verdicts(spark, d):
    return co.concept_verdict(_labelled(spark, d), _audit(spark, d))


@query("concept_verdict", sql(VERDICT, "SELECT * FROM verdicts", VERDICT_DOUBLES))
def _(spark, d):
    return _verdicts(spark, d)


GAP_TAIL = GAP[len(PR):]


@query(
    "severity_rollup",
    sql(
        VERDICT + GAP_TAIL.replace("wl AS", "wl2 AS").replace("FROM wl)", "FROM wl2)").replace("nc AS", "nc2 AS").replace("FROM nc)", "FROM nc2)"),
        """SELECT CASE WHEN severity = 'critical' OR (supported AND gap > 0.15) THEN 'critical' WHEN supported OR severity = 'moderate' THEN 'high' ELSE 'moderate' END AS severity,
             severity AS leak_severity, supported FROM gap, (SELECT bool_or(verdict = 'supported') AS supported FROM verdicts)""",
    ),
)
def _(spark, d):
    return im.severity_rollup(_gap(spark, d), _verdicts(spark, d))

"""Queries of the matrix, gene-set, summary and statistics operators, each with the same query as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matrixloom.functions import text
from matrixloom.functions.numbers import rounded
from matrixloom.operators import classify, consolidate, controls, decompose, genesets, matrix, order, packed, pseudobulk, scoring, spatial, stats, summarize
from matrixloom.operators.wide import clean_symbol
from matrixloom.plans import numbered
from matrixloom.plans.tables import EXPRESSION, METADATA, MODULES, PROGRAMS, PROTEOMICS, SCORES, table
from matrixloom.schema import PROGRAM_ORDER, program_dimension, slug_text
from matrixloom.session import Scratch
from matrixloom.sources.readers import profile

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def show(df: DataFrame, **digits: int) -> DataFrame:
    """All DOUBLE columns rounded, so that the order of summation doesn't show."""
    return df.select(*[rounded(F.col(c), digits.get(c, 6)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(x: str, digits: int = 6) -> str:
    return f"(round(CAST({x} AS DOUBLE) + 1.234e-9, {digits}) + CAST(0 AS DOUBLE))"


# inputs -----------------------------------------------------------------------------------------------------
def cells(spark: SparkSession, folder: str) -> DataFrame:
    """The dense expression matrix."""
    return matrix.unpivot_wide(table(spark, folder, EXPRESSION), "sample_id")


def bridge(spark: SparkSession, folder: str) -> DataFrame:
    return genesets.program_bridge(table(spark, folder, PROGRAMS), "ecm_program", "program_genes")


def metadata(spark: SparkSession, folder: str) -> DataFrame:
    """One row per sample: the latest."""
    m = table(spark, folder, METADATA)
    best = F.max(F.struct("loaded_at", "tissue", "tissue_detail", "subject_id", "sex", "age")).alias("b")
    return m.where("sample_id IS NOT NULL").groupBy("sample_id").agg(best).select("sample_id", "b.tissue", "b.tissue_detail", "b.subject_id", "b.sex", "b.age")


def scored_wide(spark: SparkSession, folder: str) -> DataFrame:
    """The stored log2 scores of each sample once, a column for each program's slug, with tissue and subject."""
    slugs = [slug_text(p) for p in PROGRAM_ORDER]
    one = table(spark, folder, SCORES).where("score_type = 'log2_mean' AND sample_id IS NOT NULL").groupBy("sample_id").agg(
        F.max(F.struct("tissue", "subject_id", *slugs)).alias("s")
    )
    return one.select("sample_id", "s.tissue", "s.subject_id", *[F.when(~F.isnan(f"s.{s}"), F.col(f"s.{s}")).alias(s) for s in slugs])


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """(sample_id, program, score) of the stored log2 scores, each sample once, with tissue and subject."""
    long = F.explode(F.array(*[F.struct(F.lit(p).alias("program"), F.col(slug_text(p)).alias("score")) for p in PROGRAM_ORDER])).alias("x")
    return scored_wide(spark, folder).select("sample_id", "tissue", "subject_id", long).select("sample_id", "tissue", "subject_id", "x.program", "x.score")


def proteins(spark: SparkSession, folder: str) -> DataFrame:
    """Cleaned proteomics rows: canonical columns, each record once."""
    p = table(spark, folder, PROTEOMICS)
    best = F.max(F.struct("loaded_at", "run_id", "tissue", "sample_type", "repository", "species", "sample_id", "gene_symbol", "log1p_nsaf", "nsaf", "confidence_score")).alias("b")
    one = p.where("record_id IS NOT NULL").groupBy("record_id").agg(best).select("record_id", "b.*")
    v = F.when(~F.isnan("log1p_nsaf"), F.col("log1p_nsaf"))
    return one.select("record_id", "run_id", text.tissue_name(F.col("tissue")).alias("tissue"), text.stripped(F.col("tissue")).alias("entered"), "sample_type", "repository", "species", "sample_id", clean_symbol(F.col("gene_symbol")).alias("gene"), v.alias("value"), text.condition_group(F.col("sample_type")).alias("condition")).where(
        "gene IS NOT NULL AND tissue IS NOT NULL AND value IS NOT NULL"
    )


def modules(spark: SparkSession, folder: str) -> DataFrame:
    """Each module once, with its genes in upper case and in order."""
    m = packed.one_list_per_key(table(spark, folder, MODULES), "module_id", ["feature_set", "ecm_program_curated", "confidence", "module_name", "short_interpretation", "top_genes"], latest="loaded_at")
    return m.withColumn("items", F.transform(packed.packed_items(F.col("top_genes")), F.upper))


def cells_of_lines(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(cells, counts): order lines as cells of an assay, parts as genes, quantities as counts."""
    li = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("cell_id"), "l_partkey", "l_returnflag", "l_linestatus", F.col("l_quantity").alias("value"))
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), text.normalize_name(F.col("p_name")).alias("gene"))
    counts = li.join(part, "l_partkey").groupBy("cell_id", "gene").agg(F.sum("value").alias("value"))
    orders = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return orders.select(F.col("o_orderkey").alias("cell_id"), F.col("c_mktsegment").alias("cell_type"), F.col("o_orderpriority").alias("compartment"), F.col("c_nationkey").alias("donor")), counts


_CELLS = f"""cells AS (SELECT sample_id, upper(gene) AS gene, CASE WHEN v IS NULL OR isnan(v) THEN 0 ELSE v END AS value FROM (
  (SELECT * FROM {EXPRESSION} WHERE sample_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sample_id) = 1)
  UNPIVOT INCLUDE NULLS (v FOR gene IN (COLUMNS(* EXCLUDE (sample_id))))))"""
_BRIDGE = f"""bridge AS (SELECT DISTINCT ecm_program AS program, upper(item) AS gene FROM ({numbered.oracle_sql()['p2_found']}) i
  JOIN (SELECT DISTINCT program_id, ecm_program FROM {PROGRAMS} WHERE ecm_program IS NOT NULL) p ON i.row_key = p.program_id WHERE field_name = 'program_genes')"""
_META = f"""meta AS (SELECT sample_id, tissue, tissue_detail, subject_id, sex, age FROM {METADATA} WHERE sample_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY loaded_at DESC NULLS LAST) = 1)"""
_SCORED = f"""one AS (SELECT * FROM {SCORES} WHERE score_type = 'log2_mean' AND sample_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY tissue DESC NULLS LAST, subject_id DESC NULLS LAST) = 1),
  scored AS ({' UNION ALL '.join(f"SELECT sample_id, tissue, subject_id, '{p}' AS program, CASE WHEN isnan({slug_text(p)}) THEN NULL ELSE {slug_text(p)} END AS score FROM one" for p in PROGRAM_ORDER)})"""
_WORDS = lambda words: " OR ".join(f"contains(t, '{w}')" for w in words)
# most tissues are reported with capitals, two under another name
_TISSUE = lambda c: rf"""(CASE lower(regexp_replace({c}, '^\s+|\s+$', '', 'g')) WHEN 'retina' THEN 'Eye' WHEN 'blood vessels' THEN 'Blood Vessel' WHEN 'blood vessel' THEN 'Blood Vessel' WHEN 'fallopian tube' THEN 'Fallopian Tube'
  WHEN 'adipose tissue' THEN 'Adipose Tissue' WHEN 'cervix uteri' THEN 'Cervix Uteri' WHEN 'small intestine' THEN 'Small Intestine' ELSE CASE WHEN regexp_full_match(lower(regexp_replace({c}, '^\s+|\s+$', '', 'g')),
  'skin|stomach|colon|kidney|lung|liver|ovary|prostate|breast|tooth|omentum|eye|muscle|heart|brain|nerve|bladder|thyroid|pancreas|uterus|esophagus|spleen|testis|vagina')
  THEN upper(regexp_replace({c}, '^\s+|\s+$', '', 'g')[1:1]) || lower(regexp_replace({c}, '^\s+|\s+$', '', 'g')[2:]) ELSE regexp_replace({c}, '^\s+|\s+$', '', 'g') END END)"""  # noqa: E731
_PROTEINS = rf"""proteins AS (SELECT *, CASE WHEN {_WORDS(text.DISEASE_KEYWORDS)} THEN 'disease_like' WHEN {_WORDS(text.NORMAL_KEYWORDS)} THEN 'normal_like' ELSE 'uncertain' END AS condition FROM (
  SELECT record_id, run_id, {_TISSUE('tissue')} AS tissue, regexp_replace(tissue, '^\s+|\s+$', '', 'g') AS entered,
    sample_type, repository, species, sample_id, upper(regexp_replace(gene_symbol, '^[\s\x{{00a0}}\x{{2000}}-\x{{200b}}\x{{202f}}\x{{3000}}\x{{feff}}]+|[\s\x{{00a0}}\x{{2000}}-\x{{200b}}\x{{202f}}\x{{3000}}\x{{feff}}]+$', '', 'g')) AS gene, log1p_nsaf AS value,
    regexp_replace(lower(regexp_replace(coalesce(sample_type, ''), '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g') AS t
  FROM (SELECT * FROM {PROTEOMICS} WHERE record_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY loaded_at DESC NULLS LAST) = 1))
  WHERE gene NOT IN ('', 'NAN', 'NONE') AND tissue IS NOT NULL AND value IS NOT NULL AND NOT isnan(value))"""
_MODULES = f"""modules AS (SELECT module_id, feature_set, ecm_program_curated, confidence, module_name, short_interpretation FROM {MODULES} WHERE module_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY module_id ORDER BY loaded_at DESC NULLS LAST) = 1),
  items AS (SELECT row_key AS module_id, item_pos, upper(item) AS gene FROM ({numbered.oracle_sql()['p2_found']}) WHERE field_name = 'top_genes')"""
_LINES = """lines AS (SELECT l_orderkey AS cell_id, upper(p_name) AS gene, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
  assay AS (SELECT o_orderkey AS cell_id, c_mktsegment AS cell_type, o_orderpriority AS compartment, c_nationkey AS donor FROM orders JOIN customer ON o_custkey = c_custkey)"""
_MOMENTS = "moments AS (SELECT gene, avg(value) AS mean, round(stddev_pop(value), 12) AS sd FROM cells GROUP BY 1), z AS (SELECT c.*, coalesce((value - mean) / nullif(sd, 0), 0) AS z FROM cells c JOIN moments USING (gene))"
_RANKED = "ranked AS (SELECT *, (rank() OVER (PARTITION BY sample_id ORDER BY value) + (count(*) OVER (PARTITION BY sample_id, value) - 1) / 2.0 - 1) / nullif(count(*) OVER (PARTITION BY sample_id) - 1, 0) AS pct FROM z)"
_Q = "q AS (SELECT sample_id, quantile_cont(value, 0.9) AS q0, quantile_cont(value, 0.8) AS q1 FROM cells GROUP BY 1)"
_FIVE = f"""WITH {_CELLS}, {_BRIDGE}, {_MOMENTS}, {_RANKED}, {_Q} SELECT sample_id, program, count(*) AS n_genes, {r('avg(value)')} AS mean, {r('avg(z)')} AS zscore_mean, {r('avg(pct)')} AS rank_percentile,
  {r('avg(CASE WHEN value >= q0 THEN 1.0 ELSE 0.0 END)')} AS top10_fraction, {r('avg(CASE WHEN value >= q1 THEN 1.0 ELSE 0.0 END)')} AS top20_fraction
  FROM ranked JOIN q USING (sample_id) JOIN bridge USING (gene) GROUP BY 1, 2"""


# matrices ---------------------------------------------------------------------------------------------------
@query(f"WITH {_PROTEINS} SELECT tissue AS sample_id, gene, {r('avg(value)')} AS value FROM proteins GROUP BY 1, 2")
def matrix_mean_long(spark, folder):
    p = proteins(spark, folder)
    return show(matrix.pivot_mean(p, F.col("tissue"), F.col("gene"), F.col("value")))


@query(f"WITH {_PROTEINS}, m AS (SELECT repository AS sample_id, condition AS gene, avg(value) AS value FROM proteins GROUP BY 1, 2) SELECT s.sample_id, g.gene, {r('log2(coalesce(value, 0) + 1)')} AS value FROM (SELECT DISTINCT sample_id FROM m) s CROSS JOIN (SELECT DISTINCT gene FROM m) g LEFT JOIN m USING (sample_id, gene)")
def matrix_dense_log2(spark, folder):
    p = proteins(spark, folder)
    return show(matrix.log_transformed(matrix.densify(matrix.pivot_mean(p, F.col("repository"), F.col("condition"), F.col("value")))))


_SOME = ["VATX15", "KUDQ26", "KURV16", "QESN13B", "QADQ20P"]


@query(f"WITH {_PROTEINS} SELECT repository AS sample_id, {', '.join(r(f'''coalesce(avg(value) FILTER (gene = '{g}'), 0)''') + ' AS ' + g for g in _SOME)} FROM proteins GROUP BY 1")
def matrix_wide_pivot(spark, folder):
    p = proteins(spark, folder)
    return show(matrix.wide(matrix.pivot_mean(p, F.col("repository"), F.col("gene"), F.col("value")), _SOME))


@query(f"WITH {_CELLS}, {_MOMENTS} SELECT sample_id, gene, {r('value')} AS value, {r('z')} AS z FROM z")
def gene_zscore(spark, folder):
    return show(matrix.zscores_by_moments(cells(spark, folder)).select("sample_id", "gene", "value", "z"))


@query(f"""WITH {_SCORED}, t AS (SELECT tissue, program, avg(score) AS value FROM scored WHERE tissue IS NOT NULL AND score IS NOT NULL GROUP BY 1, 2)
  SELECT tissue, program, {r('coalesce((value - avg(value) OVER w) / nullif(round(stddev_pop(value) OVER w, 12), 0), 0)')} AS z, {r('coalesce((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0), 0)')} AS scaled FROM t WINDOW w AS (PARTITION BY program)""")
def row_zscore_minmax(spark, folder):
    t = scored(spark, folder).where("tissue IS NOT NULL AND score IS NOT NULL").groupBy("tissue", "program").agg(F.avg("score").alias("value"))
    return show(matrix.row_minmax(matrix.row_zscores(t, "program"), "program").select("tissue", "program", "z", "scaled"))


@query(f"WITH {_CELLS}, {_MOMENTS}, {_RANKED} SELECT sample_id, gene, {r('pct')} AS pct FROM ranked")
def rank_percentile_cell(spark, folder):
    return show(matrix.rank_percentiles(cells(spark, folder)).select("sample_id", "gene", "pct"))


@query(f"WITH {_CELLS}, {_Q} SELECT sample_id, {r('q0')} AS q0, {r('q1')} AS q1 FROM q")
def row_quantile_threshold(spark, folder):
    return show(matrix.row_quantiles(cells(spark, folder), [0.9, 0.8]))


@query(f"WITH {_PROTEINS}, m AS (SELECT tissue, gene, avg(value) AS v FROM proteins GROUP BY 1, 2), n AS (SELECT count(DISTINCT tissue) AS n FROM m) SELECT gene FROM m GROUP BY 1 HAVING (CASE WHEN count(*) < (SELECT n FROM n) THEN greatest(max(v), 0) ELSE max(v) END) > (CASE WHEN count(*) < (SELECT n FROM n) THEN least(min(v), 0) ELSE min(v) END)")
def variable_genes(spark, folder):
    m = matrix.pivot_mean(proteins(spark, folder), F.col("tissue"), F.col("gene"), F.col("value"))
    return matrix.variable_genes(m, m.select("sample_id").distinct().count())


@query(f"WITH {_PROTEINS}, {_BRIDGE} SELECT DISTINCT gene FROM bridge WHERE gene NOT IN (SELECT gene FROM proteins)")
def missing_genes(spark, folder):
    return matrix.universe(proteins(spark, folder).select("gene"), bridge(spark, folder))[1]


@query(f"WITH {_PROTEINS}, {_BRIDGE} SELECT gene, count(*) AS n_rows FROM proteins WHERE gene IN (SELECT gene FROM bridge) GROUP BY 1")
def universe_split(spark, folder):
    return matrix.universe(proteins(spark, folder).select("gene"), bridge(spark, folder))[0].groupBy("gene").agg(F.count("*").alias("n_rows"))


# programs ---------------------------------------------------------------------------------------------------
@query(_FIVE)
def program_scores(spark, folder):
    return show(scores(spark, folder).withColumn("n_genes", F.col("n_genes").cast("bigint")))


def scores(spark, folder, methods=scoring.METHODS):
    """(sample_id, program, n_genes, methods) of the expression matrix, a row at a time."""
    df = table(spark, folder, EXPRESSION)
    columns = [c for c in df.columns if c != "sample_id"]
    rows = Scratch(spark, "rows").save(matrix.row_matrix(df, "sample_id", columns))
    return scoring.score_rows(rows, [c.upper() for c in columns], bridge(spark, folder), methods=methods)


@query(f"""WITH {_CELLS}, {_BRIDGE}, g AS (SELECT DISTINCT gene FROM cells) SELECT program, count(*) AS n_genes, count(g.gene) AS n_available, {r('count(g.gene) / count(*)')} AS fraction,
  coalesce(string_agg(g.gene, ', ' ORDER BY g.gene), '') AS available, coalesce(string_agg(CASE WHEN g.gene IS NULL THEN b.gene END, ', ' ORDER BY b.gene), '') AS missing FROM bridge b LEFT JOIN g USING (gene) GROUP BY 1""")
def program_availability(spark, folder):
    genes = spark.createDataFrame([(c.upper(),) for c in table(spark, folder, EXPRESSION).columns if c != "sample_id"], "gene STRING")
    return show(genesets.availability(bridge(spark, folder), genes))


@query(f"WITH {_BRIDGE} SELECT program, CAST(row_number() OVER (PARTITION BY program ORDER BY gene) AS INTEGER) AS rank, gene FROM bridge")
def program_gene_long(spark, folder):
    return genesets.numbered_genes(bridge(spark, folder))


@query(f"WITH {_PROTEINS}, {_BRIDGE}, m AS (SELECT run_id AS sample_id, gene, avg(value) AS value FROM proteins WHERE run_id IS NOT NULL GROUP BY 1, 2), b AS (SELECT * FROM bridge WHERE gene IN (SELECT gene FROM m)) SELECT sample_id, program, {r('sum(value) / any_value(n)')} AS score FROM m JOIN b USING (gene) JOIN (SELECT program, count(*) AS n FROM b GROUP BY 1) USING (program) GROUP BY 1, 2")
def sparse_weighted_scores(spark, folder):
    m = matrix.pivot_mean(proteins(spark, folder), F.col("run_id"), F.col("gene"), F.col("value"))
    return show(scoring.sparse_scores(m, bridge(spark, folder)))


@query(f"WITH {_CELLS}, {_BRIDGE}, {_MOMENTS} SELECT sample_id, program, {r('avg(z)')} AS score FROM z JOIN bridge USING (gene) WHERE (sample_id, program) IN (SELECT (sample_id, program) FROM cells JOIN bridge USING (gene) WHERE value <> 0) GROUP BY 1, 2")
def sparse_zscore_mean(spark, folder):
    c = cells(spark, folder)
    return show(scoring.sparse_zscore_means(c.where("value <> 0"), bridge(spark, folder), c.select("sample_id").distinct().count()))


@query(f"""WITH {_CELLS}, {_BRIDGE}, {_META}, f AS (SELECT sample_id, CAST(('0x' || md5('42|' || coalesce(subject_id, ''))[1:8])::BIGINT % 3 AS INTEGER) AS fold FROM meta),
  c AS (SELECT * FROM cells JOIN f USING (sample_id)), m AS (SELECT t.fold AS test_fold, gene, avg(value) AS mean, round(stddev_pop(value), 9) AS sd FROM c JOIN (SELECT DISTINCT fold FROM f) t ON c.fold <> t.fold GROUP BY 1, 2)
  SELECT sample_id, program, {r('avg(coalesce((value - mean) / nullif(sd, 0), 0))', 5)} AS score FROM c JOIN m ON c.gene = m.gene AND c.fold = m.test_fold JOIN bridge b ON b.gene = c.gene GROUP BY 1, 2""")
def foldwise_scores(spark, folder):
    f = classify.grouped_folds(metadata(spark, folder).select("sample_id", "subject_id"), "subject_id", 3).select("sample_id", "fold")
    return show(scoring.foldwise_scores(cells(spark, folder), bridge(spark, folder), f).where("is_test").select("sample_id", "program", "score"), score=5)


@query(f"WITH {_MODULES} SELECT m1.module_id AS a, m2.module_id AS b, count(*) AS n, {r('count(*) / (any_value(m1.k) + any_value(m2.k) - count(*))')} AS jaccard, {r('count(*) / least(any_value(m1.k), any_value(m2.k))')} AS overlap FROM (SELECT module_id, gene, count(*) OVER (PARTITION BY module_id) AS k FROM (SELECT DISTINCT module_id, gene FROM items JOIN modules USING (module_id) WHERE feature_set = 'proteoglycans')) m1 JOIN (SELECT module_id, gene, count(*) OVER (PARTITION BY module_id) AS k FROM (SELECT DISTINCT module_id, gene FROM items JOIN modules USING (module_id) WHERE feature_set = 'collagens')) m2 USING (gene) GROUP BY 1, 2")
def module_overlap_between_sets(spark, folder):
    m = modules(spark, folder).select("feature_set", F.col("module_id").alias("name"), F.explode("items").alias("gene"))
    o = genesets.overlaps(m.where("feature_set = 'proteoglycans'"), m.where("feature_set = 'collagens'"))
    return show(o.select("a", "b", "n", "jaccard", "overlap"))


@query()
def module_overlap_within_sets(spark, folder):
    """All modules of each feature set against one another."""
    m = modules(spark, folder).where("feature_set IS NOT NULL").select("feature_set", F.col("module_id").alias("name"), F.explode("items").alias("gene"))
    # a gene counts per feature set, so that modules of different ones never meet
    o = genesets.overlaps(m.select("name", F.concat_ws("|", "feature_set", "gene").alias("gene")))
    return show(o.join(m.select(F.col("name").alias("a"), "feature_set").distinct(), "a").select("feature_set", "a", "b", "n", "jaccard", "overlap"))


_MATCH = f"""WITH {_MODULES}, {_BRIDGE}, s AS (SELECT DISTINCT module_id, gene FROM items), k AS (SELECT module_id, count(*) AS na FROM s GROUP BY 1), kb AS (SELECT program, count(*) AS nb FROM bridge GROUP BY 1),
  p AS (SELECT module_id AS a, program AS b, count(*) AS n, any_value(na) AS na, any_value(nb) AS nb FROM s JOIN bridge USING (gene) JOIN k USING (module_id) JOIN kb USING (program) GROUP BY 1, 2),
  best AS (SELECT *, n / (na + nb - n) AS j, n / least(na, nb) AS o FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY n / least(na, nb) DESC, n / (na + nb - n) DESC, n DESC, b) = 1)"""


@query(f"{_MATCH} SELECT a, b, n, {r('j')} AS jaccard, {r('o')} AS overlap, n >= 4 AND o >= 0.13 AS is_match, CASE WHEN n >= 4 AND o >= 0.13 THEN b ELSE 'Unassigned/weak match' END AS assigned FROM best")
def best_match(spark, folder):
    m = modules(spark, folder).select(F.col("module_id").alias("name"), F.explode("items").alias("gene"))
    best = genesets.best_match(genesets.overlaps(m, bridge(spark, folder).withColumnRenamed("program", "name")))
    return show(best.select("a", "b", "n", "jaccard", "overlap", "is_match", "assigned"))


@query(f"{_MATCH} SELECT b AS program, count(*) AS n_modules, CAST(count_if(n >= 4 AND o >= 0.13) AS BIGINT) AS n_recovered, {r('avg(CASE WHEN n >= 4 AND o >= 0.13 THEN 1.0 ELSE 0.0 END)')} AS recovery, {r('avg(o)')} AS mean_overlap FROM best GROUP BY 1")
def recovery_summary(spark, folder):
    m = modules(spark, folder).select(F.col("module_id").alias("name"), F.explode("items").alias("gene"))
    best = genesets.best_match(genesets.overlaps(m, bridge(spark, folder).withColumnRenamed("program", "name")))
    return show(best.groupBy(F.col("b").alias("program")).agg(F.count("*").alias("n_modules"), F.count_if("is_match").alias("n_recovered"), F.avg(F.col("is_match").cast("double")).alias("recovery"), F.avg("overlap").alias("mean_overlap")))


_SETS = ["all_matrisome", "core_matrisome", "ecm_glycoproteins", "collagens", "proteoglycans"]


@query(f"WITH {_MODULES} SELECT ecm_program_curated, {', '.join(f'''CAST(count_if(feature_set = '{s}') AS BIGINT) AS {s}''' for s in _SETS)} FROM modules GROUP BY 1")
def presence_matrix(spark, folder):
    return genesets.presence(modules(spark, folder).select("ecm_program_curated", "feature_set"), "ecm_program_curated", "feature_set", _SETS)


_CONF = "CASE trim(confidence) WHEN 'Very high' THEN 5 WHEN 'High' THEN 4 WHEN 'Moderate-high' THEN 3 WHEN 'Moderate' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END"


@query(f"""WITH {_MODULES}, lead AS (SELECT * FROM items WHERE item_pos <= 5), first AS (SELECT ecm_program_curated AS program, gene, min((module_id, item_pos)) AS f FROM lead JOIN modules USING (module_id) GROUP BY 1, 2),
  top AS (SELECT program, string_agg(gene, ', ' ORDER BY f, gene) AS lead_genes FROM (SELECT * FROM first QUALIFY row_number() OVER (PARTITION BY program ORDER BY f, gene) <= 25) GROUP BY 1)
  SELECT m.*, lead_genes FROM (SELECT ecm_program_curated AS program, count(*) AS n_modules, count(DISTINCT feature_set) AS n_feature_sets, CAST(count_if({_CONF} >= 4) AS BIGINT) AS n_confident, max({_CONF}) AS best_confidence FROM modules GROUP BY 1) m LEFT JOIN top USING (program)""")
def program_rollup(spark, folder):
    m = modules(spark, folder).select(F.col("ecm_program_curated").alias("program"), "module_id", "feature_set", text.confidence_score(F.col("confidence")).alias("confidence_score"), "items")
    return genesets.program_rollup(m)


@query(f"""WITH {_PROTEINS}, {_BRIDGE}, sets AS (SELECT 'all' AS feature_set, gene FROM bridge UNION SELECT 'program__' || trim(regexp_replace(lower(program), '[^a-z0-9]+', '_', 'g'), '_'), gene FROM bridge)
  SELECT feature_set, gene FROM sets QUALIFY count(*) OVER (PARTITION BY feature_set) >= 10""")
def feature_sets(spark, folder):
    return genesets.feature_sets(bridge(spark, folder), {"program": "program"}, min_genes=10)


# joins, labels, filters -------------------------------------------------------------------------------------
_SYS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.TISSUE_SYSTEM.items())


@query(f"""WITH {_CELLS}, {_META}, s AS (SELECT DISTINCT sample_id FROM cells) SELECT sample_id, coalesce(subject_id, CASE WHEN sample_id LIKE 'GTEX-%' THEN array_to_string(string_split(sample_id, '-')[1:2], '-') ELSE '' END) AS subject_id,
  tissue, CASE tissue {_SYS} ELSE 'Other' END AS tissue_system FROM s LEFT JOIN meta USING (sample_id)""")
def sample_metadata_join(spark, folder):
    s = table(spark, folder, EXPRESSION).select("sample_id").where("sample_id IS NOT NULL").distinct().join(metadata(spark, folder), "sample_id", "left")
    s = s.withColumn("subject_id", F.coalesce("subject_id", text.subject_id(F.col("sample_id"))))
    return text.map_label(s, "tissue", text.TISSUE_SYSTEM, "tissue_system", "Other").select("sample_id", "subject_id", "tissue", "tissue_system")


@query(f"WITH {_META}, {_SCORED} SELECT s.sample_id, m.tissue_detail, program, {r('score')} AS score FROM meta m RIGHT JOIN (SELECT * FROM scored WHERE program = 'CNS/neural ECM') s ON m.sample_id = s.sample_id")
def right_join_scores(spark, folder):
    s = scored(spark, folder).where("program = 'CNS/neural ECM'").select("sample_id", "program", "score")
    return show(metadata(spark, folder).select("sample_id", "tissue_detail").join(s, "sample_id", "right"))


@query(f"""WITH a AS (SELECT sample_id, max(cns_neural_ecm) AS v FROM {SCORES} WHERE score_type = 'log2_mean' AND NOT isnan(cns_neural_ecm) GROUP BY 1), b AS (SELECT sample_id, max(cns_neural_ecm) AS v FROM {SCORES} WHERE score_type = 'zscore_mean' AND NOT isnan(cns_neural_ecm) GROUP BY 1)
  SELECT sample_id, {r('a.v')} AS score_new, {r('b.v')} AS score_old FROM a JOIN b USING (sample_id)""")
def inner_join_suffix(spark, folder):
    s = table(spark, folder, SCORES).where("cns_neural_ecm IS NOT NULL AND NOT isnan(cns_neural_ecm)").groupBy("sample_id", "score_type").agg(F.max("cns_neural_ecm").alias("v"))
    new, old = (s.where(F.col("score_type") == t).select("sample_id", F.col("v").alias(f"score_{n}")) for t, n in (("log2_mean", "new"), ("zscore_mean", "old")))
    return show(new.join(old, "sample_id"))


def _case(rules, default, col="t"):
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({col}, '{w}')" for w in words) + f" THEN '{label}'" for label, words in rules) + f" ELSE '{default}' END"


@query(f"WITH {_META}, d AS (SELECT tissue_detail, lower(trim(coalesce(tissue_detail, ''))) AS t FROM meta) SELECT tissue_detail, {_case(text.DETAIL_SYSTEM_RULES, 'unknown')} AS detail_system, {_case(text.BRAIN_REGION_RULES, 'unknown')} AS brain_region, {_case(text.CELL_LINEAGE_RULES, 'unknown')} AS lineage, count(*) AS n FROM d GROUP BY ALL")
def keyword_label_maps(spark, folder):
    d = metadata(spark, folder).select("tissue_detail", text.normalize_text(F.coalesce("tissue_detail", F.lit("")), collapse=False).alias("t"))
    kinds = {"detail_system": text.DETAIL_SYSTEM_RULES, "brain_region": text.BRAIN_REGION_RULES, "lineage": text.CELL_LINEAGE_RULES}
    return d.select("tissue_detail", *[text.keyword_rules(F.col("t"), v).alias(k) for k, v in kinds.items()]).groupBy("tissue_detail", *kinds).agg(F.count("*").alias("n"))


@query(f"WITH {_PROTEINS} SELECT sample_type, condition, count(*) AS n FROM proteins GROUP BY 1, 2")
def condition_classify(spark, folder):
    return proteins(spark, folder).groupBy("sample_type", "condition").agg(F.count("*").alias("n"))


@query(f"WITH {_PROTEINS} SELECT coalesce(condition, 'all_samples') AS condition, count(*) AS n, count(DISTINCT gene) AS n_genes, count(DISTINCT run_id) AS n_runs, count(DISTINCT repository) AS n_repositories, {r('avg(value)')} AS mean_value, {r('median(value)')} AS median_value, {r('max(value)')} AS max_value FROM proteins GROUP BY ROLLUP (condition)")
def condition_grouping_sets(spark, folder):
    p = proteins(spark, folder)
    totals = summarize.with_totals(p, "condition", "all_samples", [
        F.count("*").alias("n"), F.count_distinct("gene").alias("n_genes"), F.count_distinct("run_id").alias("n_runs"), F.count_distinct("repository").alias("n_repositories"),
        F.avg("value").alias("mean_value"), F.max("value").alias("max_value"),
    ])
    every = p.select("condition", "value").unionByName(p.select(F.lit("all_samples").alias("condition"), "value"))
    medians = order.quantiles(every, ["condition"], "value", [0.5]).select("condition", F.col("q0").alias("median_value"))
    return show(totals.join(medians, "condition"))


@query(f"WITH {_PROTEINS} SELECT coalesce(condition, 'all_samples') AS condition, tissue, gene, {r('avg(value)')} AS mean_value, {r('max(value)')} AS max_value, count(DISTINCT sample_id) AS n_samples, CAST(count(DISTINCT sample_id) > 0 AS INTEGER) AS present FROM proteins GROUP BY GROUPING SETS ((tissue, gene, condition), (tissue, gene))")
def fourway_matrix(spark, folder):
    return show(summarize.four_way_matrix(proteins(spark, folder)))


@query(f"WITH {_PROTEINS} SELECT DISTINCT sample_type, tissue, repository, species, condition FROM proteins")
def distinct_sample_types(spark, folder):
    return proteins(spark, folder).select("sample_type", "tissue", "repository", "species", "condition").distinct()


@query(f"WITH {_META} SELECT sample_id, tissue FROM meta WHERE tissue IS NOT NULL QUALIFY count(*) OVER (PARTITION BY tissue) >= 60")
def class_size_filter(spark, folder):
    return summarize.large_classes(metadata(spark, folder).select("sample_id", "tissue"), "tissue", 60)


@query(f"WITH {_MODULES}, t AS (SELECT module_id, lower(coalesce(module_name, '') || ' ' || coalesce(short_interpretation, '')) AS t FROM modules) SELECT module_id, " + """CASE WHEN contains(t,'cns') OR contains(t,'neural') OR contains(t,'retinal') THEN CASE WHEN contains(t,'retinal') THEN 'Retinal/sensory ECM' ELSE 'CNS/neural ECM' END
  WHEN contains(t,'epithelial') OR contains(t,'mucosal') OR contains(t,'basement membrane') THEN CASE WHEN contains(t,'renal') OR contains(t,'endothelial') OR contains(t,'kidney') THEN 'Renal/endothelial basement membrane ECM' WHEN contains(t,'reproductive') THEN 'Reproductive-specialized ECM' ELSE 'Epithelial/mucosal basement membrane ECM' END
  WHEN contains(t,'vascular') OR contains(t,'connective') OR contains(t,'stromal') OR contains(t,'interstitial') OR contains(t,'fibroblastic') THEN CASE WHEN contains(t,'remodeling') THEN 'Stromal remodeling ECM' ELSE 'Vascular/stromal/interstitial ECM' END
  WHEN contains(t,'immune') OR contains(t,'lymphoid') OR contains(t,'hematopoietic') THEN 'Immune/lymphoid remodeling ECM' WHEN contains(t,'hepatic') OR contains(t,'plasma') OR contains(t,'liver') THEN 'Hepatic/plasma-associated ECM'
  WHEN contains(t,'reproductive') OR contains(t,'secretory') OR contains(t,'epididymis') OR contains(t,'seminal') THEN 'Reproductive-specialized ECM' WHEN contains(t,'placenta') THEN 'Placental/stromal ECM' WHEN contains(t,'endocrine') THEN 'Endocrine-associated ECM' ELSE 'Other/specialized ECM' END AS program FROM t""")
def module_program_from_text(spark, folder):
    return modules(spark, folder).select("module_id", text.assign_program(F.col("module_name"), F.col("short_interpretation")).alias("program"))


@query(f"WITH {_MODULES} SELECT module_id, confidence, {_CONF} AS score FROM modules")
def confidence_scores(spark, folder):
    return modules(spark, folder).select("module_id", "confidence", text.confidence_score(F.col("confidence")).alias("score"))


_SUPPORT = f"WITH {_PROTEINS}, {_BRIDGE}, d AS (SELECT DISTINCT gene FROM proteins), s AS (SELECT program, count(*) AS n, count(d.gene) AS hit, count(d.gene) / count(*) AS f FROM bridge b LEFT JOIN d USING (gene) GROUP BY 1)"


@query(f"{_SUPPORT} SELECT program, n AS n_genes, hit AS n_available, {r('f')} AS fraction, CASE WHEN f <= 0.5 THEN 'weak' WHEN f <= 0.7 THEN 'moderate' WHEN f <= 0.85 THEN 'strong' ELSE 'very strong' END AS support, CASE WHEN f >= 0.85 THEN 'very strong' WHEN f >= 0.7 THEN 'strong' WHEN f >= 0.5 THEN 'moderate' ELSE 'weak' END AS strength FROM s")
def protein_support(spark, folder):
    a = genesets.availability(bridge(spark, folder), proteins(spark, folder).select("gene"))
    return show(a.select("program", "n_genes", "n_available", "fraction", text.support_level(F.col("fraction")).alias("support"), text.validation_strength(F.col("fraction")).alias("strength")))


@query(f"WITH {_MODULES} SELECT module_id, len(list(gene)) AS n_items, string_agg(gene, ', ' ORDER BY item_pos) AS genes, (SELECT string_agg(g, ', ' ORDER BY g) FROM (SELECT DISTINCT gene AS g FROM items i2 WHERE i2.module_id = items.module_id)) AS unique_genes FROM items GROUP BY module_id")
def list_parse_normalize(spark, folder):
    m = modules(spark, folder).where(F.size("items") > 0)
    return m.select("module_id", F.size("items").cast("bigint").alias("n_items"), F.array_join("items", ", ").alias("genes"), F.array_join(F.array_sort(F.array_distinct("items")), ", ").alias("unique_genes"))


@query(f"SELECT DISTINCT ecm_program AS program, trim(regexp_replace(lower(ecm_program), '[^a-z0-9]+', '_', 'g'), '_') AS slug, CAST(nullif(list_position([{', '.join(repr(p) for p in PROGRAM_ORDER)}], ecm_program), 0) - 1 AS INTEGER) AS ord FROM {PROGRAMS}")
def program_order(spark, folder):
    p = table(spark, folder, PROGRAMS).select(F.col("ecm_program").alias("program")).distinct()
    d = p.join(F.broadcast(program_dimension(spark).select("program", "ord")), "program", "left")
    return d.select("program", text.slug(F.col("program")).alias("slug"), "ord")


# summaries --------------------------------------------------------------------------------------------------
def _summary_sql(groups: str, source: str) -> str:
    g = ", ".join(f"s.{x}" for x in groups.split(", "))
    same = " AND ".join(f"s.{x} IS NOT DISTINCT FROM c.{x}" for x in groups.split(", "))
    return f"""SELECT {g}, program, n_samples, n_subjects, {r('avg(score)')} AS mean_score, {r('median(score)')} AS median_score, {r('stddev_pop(score)')} AS std_score, {r('quantile_cont(score, 0.25)')} AS q25_score, {r('quantile_cont(score, 0.75)')} AS q75_score
    FROM {source} s JOIN (SELECT {groups}, count(DISTINCT sample_id) AS n_samples, count(DISTINCT subject_id) AS n_subjects FROM {source} GROUP BY ALL) c ON {same} WHERE score IS NOT NULL GROUP BY ALL"""


@query(f"WITH {_SCORED} {_summary_sql('tissue', 'scored')}")
def group_summary(spark, folder):
    return show(summarize.group_summary(scored(spark, folder), ["tissue"]))


@query(f"WITH {_SCORED}, {_META}, two AS (SELECT s.*, m.tissue_detail, m.sex FROM scored s JOIN meta m USING (sample_id)) {_summary_sql('tissue_detail, sex', 'two')}")
def group_summary_two_level(spark, folder):
    two = scored(spark, folder).join(metadata(spark, folder).select("sample_id", "tissue_detail", "sex"), "sample_id")
    return show(summarize.group_summary(two, ["tissue_detail", "sex"]))


@query(f"WITH {_SCORED} SELECT program, tissue, sample_id, {r('score')} AS score, CAST(row_number() OVER (PARTITION BY program, tissue ORDER BY score DESC, sample_id) AS INTEGER) AS rank FROM scored WHERE score IS NOT NULL QUALIFY rank <= 10")
def top_samples_per_program(spark, folder):
    t = summarize.top_k(scored(spark, folder).where("score IS NOT NULL"), ["program", "tissue"], [F.desc("score"), F.col("sample_id")], 10)
    return show(t.select("program", "tissue", "sample_id", "score", "rank"))


@query(f"WITH {_SCORED} SELECT program, subject_id, count(*) AS n, {r('avg(score)')} AS mean_score, {r('stddev_pop(score)')} AS std_score, {r('abs(stddev_pop(score) / nullif(avg(score), 0))', 4)} AS variability FROM scored WHERE score IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1 AND abs(avg(score)) > 0.01")
def donor_variability(spark, folder):
    v = summarize.variability(scored(spark, folder), ["program", "subject_id"]).where("n > 1 AND abs(mean_score) > 0.01")
    return show(v, variability=4)


@query(f"""WITH {_CELLS}, {_BRIDGE}, {_META}, {_MOMENTS}, s AS (SELECT program, tissue AS item, 'mean' AS method, avg(value) AS score FROM cells JOIN bridge USING (gene) JOIN meta USING (sample_id) WHERE tissue IS NOT NULL GROUP BY 1, 2
  UNION ALL SELECT program, tissue, 'zscore_mean', avg(z) FROM z JOIN bridge USING (gene) JOIN meta USING (sample_id) WHERE tissue IS NOT NULL GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY program, method ORDER BY round(score, 9) DESC, item) AS rank FROM s QUALIFY rank <= 10)
  SELECT program, item, count(DISTINCT method) AS n_methods, string_agg(DISTINCT method, ', ' ORDER BY method) AS methods, CAST(min(rank) AS INTEGER) AS best_rank, {r('avg(score)')} AS mean_score, {r('max(score)')} AS max_score, count(DISTINCT method) >= 2 AS consensus FROM t GROUP BY 1, 2""")
def cross_method_consensus(spark, folder):
    return _consensus(spark, folder, ("mean", "zscore_mean"))


@query()
def all_method_consensus(spark, folder):
    """The consensus of all scoring methods."""
    return _consensus(spark, folder, scoring.METHODS)


def _consensus(spark, folder, methods):
    s = scores(spark, folder, methods)
    t = scoring.tidy_scores(s, methods).join(metadata(spark, folder).select("sample_id", "tissue").where("tissue IS NOT NULL"), "sample_id")
    n = s.select("sample_id", "program", "n_genes")
    per = t.join(n, ["sample_id", "program"]).groupBy("program", "method", F.col("tissue").alias("item")).agg((F.sum(F.col("score") * F.col("n_genes")) / F.sum("n_genes")).alias("score"))
    return show(summarize.consensus(summarize.top_k(per, ["program", "method"], [F.desc(F.round("score", 9)), F.col("item")], 10)))


@query(f"WITH {_MODULES} SELECT ecm_program_curated AS program, gene AS item, count(*) AS n, CAST(row_number() OVER (PARTITION BY ecm_program_curated ORDER BY count(*) DESC, gene) AS INTEGER) AS rank FROM items JOIN modules USING (module_id) WHERE ecm_program_curated IS NOT NULL GROUP BY 1, 2 QUALIFY rank <= 30")
def term_frequency(spark, folder):
    return summarize.term_frequency(modules(spark, folder).where("ecm_program_curated IS NOT NULL").withColumnRenamed("ecm_program_curated", "program"), "program", "items", 30)


@query(f"WITH {_META} SELECT tissue, sample_id FROM meta WHERE tissue IS NOT NULL QUALIFY row_number() OVER (PARTITION BY tissue ORDER BY md5('42|' || sample_id), sample_id) <= 150")
def stratified_downsample(spark, folder):
    return summarize.stratified_sample(metadata(spark, folder).where("tissue IS NOT NULL"), "tissue", "sample_id", 150).select("tissue", "sample_id")


@query(f"WITH {_SCORED}, e AS (SELECT min(score) AS lo0, max(score) AS hi0 FROM scored), b AS (SELECT CAST(least(floor((score - lo0) / ((hi0 - lo0) / 30)), 29) AS INTEGER) AS bin, lo0, hi0 FROM scored, e WHERE score IS NOT NULL) SELECT bin, {r('any_value(lo0) + bin * ((any_value(hi0) - any_value(lo0)) / 30)')} AS lo, {r('any_value(lo0) + (bin + 1) * ((any_value(hi0) - any_value(lo0)) / 30)')} AS hi, count(*) AS n FROM b GROUP BY bin")
def score_histogram(spark, folder):
    return show(summarize.histogram(scored(spark, folder), "score", 30))


@query(f"WITH {_SCORED} SELECT {r('quantile_cont(score, 0.02)')} AS lo, {r('quantile_cont(score, 0.98)')} AS hi FROM scored")
def robust_range(spark, folder):
    return show(summarize.robust_range(scored(spark, folder), "score"))


# statistics -------------------------------------------------------------------------------------------------
_RANK = "SELECT *, rank() OVER (PARTITION BY program ORDER BY score) + (count(*) OVER (PARTITION BY program, score) - 1) / 2.0 AS rk FROM scored WHERE score IS NOT NULL"


@query(f"WITH {_SCORED}, k AS ({_RANK}) SELECT x.program AS a, y.program AS b, count(*) AS n, {r('corr(x.score, y.score)')} AS pearson, {r('corr(x.rk, y.rk)')} AS spearman FROM k x JOIN k y ON x.sample_id = y.sample_id AND x.program < y.program GROUP BY 1, 2")
def program_correlations(spark, folder):
    return show(stats.pair_correlations(scored(spark, folder)))


@query(f"""WITH {_CELLS}, {_BRIDGE}, {_MOMENTS}, {_RANKED}, s AS (SELECT sample_id, program, avg(value) AS a, avg(pct) AS b FROM ranked JOIN bridge USING (gene) GROUP BY 1, 2),
  k AS (SELECT *, rank() OVER (PARTITION BY program ORDER BY round(a, 9)) + (count(*) OVER (PARTITION BY program, round(a, 9)) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY program ORDER BY round(b, 9)) + (count(*) OVER (PARTITION BY program, round(b, 9)) - 1) / 2.0 AS rb FROM s)
  SELECT program, count(*) AS n, {r('corr(round(a, 9), round(b, 9))', 5)} AS pearson, {r('corr(ra, rb)', 5)} AS spearman FROM k GROUP BY 1""")
def rank_vs_mean_corr(spark, folder):
    s = scores(spark, folder, ("mean", "rank_percentile"))
    a, b = (s.select("program", "sample_id", F.round(m, 9).alias("score")) for m in ("mean", "rank_percentile"))
    return show(stats.agreement(a, b, ["program"]), pearson=5, spearman=5)


@query()
def correlation_p_values(spark, folder):
    """p-values and adjusted p-values of the programs' correlations."""
    c = stats.pair_correlations(scored(spark, folder)).withColumn("p", stats.correlation_p("pearson", "n")).withColumn("key", F.concat_ws("|", "a", "b"))
    return stats.benjamini_hochberg(c, "p", "key").select("a", "b", "n", "pearson", "p", "p_adjusted")


_KNN = """e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0), p AS (SELECT a.vec_id AS key, b.vec_id AS neighbour, a.label, b.label AS neighbour_label, round(list_cosine_similarity(a.v, b.embedding::DOUBLE[]), 12) AS similarity FROM e a JOIN embeddings b ON a.vec_id <> b.vec_id),
  n AS (SELECT *, CAST(row_number() OVER (PARTITION BY key ORDER BY similarity DESC, neighbour) AS INTEGER) AS rank FROM p QUALIFY rank <= 10)"""


@query(f"WITH {_KNN} SELECT key, neighbour, rank, {r('similarity')} AS similarity FROM n")
def cosine_knn(spark, folder):
    n = stats.cosine_neighbours(table(spark, folder, "embeddings"), "vec_id", "embedding", 10, "label", queries="vec_id % 50 = 0")
    return show(n.select("key", "neighbour", "rank", "similarity"))


@query(f"WITH {_KNN} SELECT 5 AS k, {r('avg(s)')} AS share FROM (SELECT key, avg(CASE WHEN label = neighbour_label THEN 1.0 ELSE 0.0 END) AS s FROM n WHERE rank <= 5 GROUP BY 1)")
def knn_same_label(spark, folder):
    n = stats.cosine_neighbours(table(spark, folder, "embeddings"), "vec_id", "embedding", 10, "label", queries="vec_id % 50 = 0")
    return show(stats.same_label_share(n, 5))


@query(f"""WITH e AS (SELECT vec_id, CAST(label AS VARCHAR) AS l, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL), d AS (SELECT a.vec_id AS k, a.l, b.l AS o, sum(list_distance(a.v, b.v)) AS t, count(*) AS c FROM e a CROSS JOIN e b GROUP BY 1, 2, 3),
  p AS (SELECT k, l, max(CASE WHEN l = o AND c > 1 THEN t / (c - 1) END) AS a, min(CASE WHEN l <> o THEN t / c END) AS b FROM d GROUP BY 1, 2) SELECT count(*) AS n, count(DISTINCT l) AS labels, {r('avg(CASE WHEN a IS NULL THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END)')} AS silhouette FROM p""")
def silhouette(spark, folder):
    return show(stats.silhouette(table(spark, folder, "embeddings"), "vec_id", "embedding", "label"))


@query(f"""WITH {_META}, t AS (SELECT tissue AS a, age AS b, count(*)::DOUBLE AS n FROM meta WHERE tissue IS NOT NULL AND age IS NOT NULL GROUP BY 1, 2), ra AS (SELECT a, sum(n) AS na FROM t GROUP BY 1), rb AS (SELECT b, sum(n) AS nb FROM t GROUP BY 1), s AS (SELECT sum(n) AS total FROM t),
  x AS (SELECT any_value(total) AS n, sum(n * (n - 1) / 2) AS ij, sum(n / total * ln(n * total / (na * nb))) AS mi FROM t JOIN ra USING (a) JOIN rb USING (b), s), ea AS (SELECT sum(na * (na - 1) / 2) AS sa, -sum(na / total * ln(na / total)) AS ha FROM ra, s), eb AS (SELECT sum(nb * (nb - 1) / 2) AS sb, -sum(nb / total * ln(nb / total)) AS hb FROM rb, s)
  SELECT CAST(n AS BIGINT) AS n, {r('(ij - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2))')} AS ari, {r('mi / ((ha + hb) / 2)')} AS nmi FROM x, ea, eb""")
def label_agreement(spark, folder):
    return show(stats.label_agreement(metadata(spark, folder), "tissue", "age"))


_NULL_N = 1000
_UNIVERSE = "uni AS (SELECT gene FROM bridge UNION SELECT gene FROM proteins), sizes AS (SELECT program AS name, count(*) AS size FROM bridge GROUP BY 1)"
_DRAWS = f"draws AS (SELECT gene, rep, row_number() OVER (PARTITION BY rep ORDER BY md5('42|' || rep || '|' || gene), gene) AS place FROM uni, (SELECT unnest(range({_NULL_N})) AS rep)), sets AS (SELECT name, rep, gene FROM draws JOIN sizes ON place <= size UNION ALL SELECT program, -1, gene FROM bridge)"
_Z = "CASE WHEN count(v) >= 2 THEN (max(obs) - avg(v)) / nullif(round(stddev_samp(v), 12), 0) END"


def _universe(b, p):
    """Genes to draw from: those of the programs and all that are measured."""
    return b.select("gene").union(p.select("gene")).distinct()


def _abundance_null(spark, folder):
    scratch = Scratch(spark, "null")
    b = scratch.save(bridge(spark, folder))
    ab = scratch.save(proteins(spark, folder).groupBy("tissue", "gene").agg(F.avg("value").alias("value")))
    return controls.abundance_null(b, _universe(b, ab), ab, _NULL_N)


@query(f"""WITH {_PROTEINS}, {_BRIDGE}, {_UNIVERSE}, {_DRAWS}, seen AS (SELECT DISTINCT condition, gene FROM proteins), h AS (SELECT c.condition, s.name, s.rep, count(d.gene) / any_value(size) AS v FROM sets s JOIN sizes USING (name) CROSS JOIN (SELECT DISTINCT condition FROM seen) c LEFT JOIN seen d ON d.condition = c.condition AND d.gene = s.gene GROUP BY 1, 2, 3),
  o AS (SELECT condition, name, v AS obs FROM h WHERE rep = -1) SELECT condition, name AS program, {r('max(obs)')} AS observed, {r('avg(v)')} AS random_mean, {r('(count_if(round(v, 9) >= round(obs, 9)) + 1) / (count(*) + 1)')} AS p, {r(_Z, 4)} AS z FROM h JOIN o USING (condition, name) WHERE rep >= 0 GROUP BY 1, 2""")
def detection_null(spark, folder):
    b = bridge(spark, folder)
    p = proteins(spark, folder)
    n = controls.detection_null(b, _universe(b, p), p.select("condition", "gene"), _NULL_N)
    return show(n, z=4)


_ABUND = f"""WITH {_PROTEINS}, {_BRIDGE}, {_UNIVERSE}, {_DRAWS}, ab AS (SELECT tissue, gene, avg(value) AS value FROM proteins GROUP BY 1, 2), t AS (SELECT name, rep, tissue, avg(value) AS score FROM sets JOIN ab USING (gene) GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY name, rep ORDER BY score DESC, tissue) AS rn FROM t),
  m AS (SELECT name, rep, avg(score) AS mean_value, max(score) AS max_value, avg(score) FILTER (rn <= 3) AS top3_mean, var_pop(score) AS var_value FROM k GROUP BY 1, 2), l AS (UNPIVOT m ON mean_value, max_value, top3_mean, var_value INTO NAME metric VALUE v)"""


@query(f"{_ABUND} SELECT x.name AS program, x.metric, {r('max(o.v)')} AS observed, {r('avg(x.v)')} AS random_mean, {r('(count_if(x.v >= o.v) + 1) / (count(*) + 1)')} AS p, {r('CASE WHEN count(x.v) >= 2 THEN (max(o.v) - avg(x.v)) / nullif(round(stddev_samp(x.v), 12), 0) END', 4)} AS z FROM l x JOIN l o ON x.name = o.name AND x.metric = o.metric AND o.rep = -1 WHERE x.rep >= 0 GROUP BY 1, 2")
def abundance_null(spark, folder):
    return show(_abundance_null(spark, folder), z=4)


@query(f"""{_ABUND}, p AS (SELECT x.name AS program, x.metric, (count_if(x.v >= o.v) + 1) / (count(*) + 1) AS p FROM l x JOIN l o ON x.name = o.name AND x.metric = o.metric AND o.rep = -1 WHERE x.rep >= 0 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (ORDER BY p, program || '|' || metric) AS rn, count(*) OVER () AS n FROM p)
  SELECT program, metric, {r('p')} AS p, {r('min(least(p * n / rn, 1)) OVER (ORDER BY rn DESC ROWS UNBOUNDED PRECEDING)')} AS p_adjusted FROM r""")
def bh_fdr(spark, folder):
    n = _abundance_null(spark, folder).withColumn("key", F.concat_ws("|", "program", "metric"))
    return show(stats.benjamini_hochberg(n, "p", "key").select("program", "metric", "p", "p_adjusted"))


@query(f"WITH {_CELLS} SELECT gene AS component, count(*) AS n, {r('(sqrt(count(*)) - sum(abs(value)) / nullif(sqrt(sum(value * value)), 0)) / (sqrt(count(*)) - 1)')} AS sparsity FROM cells GROUP BY 1")
def hoyer_sparsity(spark, folder):
    return show(stats.hoyer_sparsity(cells(spark, folder), "gene", "value").withColumnRenamed("gene", "component"))


@query(f"""WITH {_SCORED}, m AS (SELECT program AS g, tissue AS kk, stddev_pop(score) AS e, avg(score) AS s, median(score) AS c, max(score) AS rc, dense_rank() OVER (PARTITION BY program ORDER BY tissue) AS k FROM scored WHERE tissue IS NOT NULL AND score IS NOT NULL GROUP BY 1, 2),
  x AS (SELECT g, k, 0.25 * (1 - (e - min(e) OVER w) / (max(e) OVER w - min(e) OVER w + 1e-12)) + 0.30 * coalesce(s, 0) + 0.20 * coalesce(c, 0) + 0.25 * coalesce(rc, 0) AS score FROM m WINDOW w AS (PARTITION BY g)) SELECT g AS program, CAST(k AS INTEGER) AS recommended_k, {r('score')} AS score FROM x QUALIFY row_number() OVER (PARTITION BY g ORDER BY score DESC, k) = 1""")
def rank_recommendation(spark, folder):
    from pyspark.sql import Window

    m = scored(spark, folder).where("tissue IS NOT NULL AND score IS NOT NULL").groupBy("program", "tissue").agg(F.stddev_pop("score").alias("e"), F.avg("score").alias("s"), F.median("score").alias("c"), F.max("score").alias("rc"))
    m = m.withColumn("k", F.dense_rank().over(Window.partitionBy("program").orderBy("tissue")))
    return show(stats.rank_recommendation(m, "program", "k", "e", "s", "c", "rc"))


@query(f"""WITH {_PROTEINS}, {_BRIDGE}, {_SCORED}, rna AS (SELECT tissue, program, avg(score) AS v FROM scored WHERE tissue IS NOT NULL AND score IS NOT NULL GROUP BY 1, 2), prot AS (SELECT tissue, program, avg(v) AS v FROM (SELECT tissue, gene, avg(value) AS v FROM proteins GROUP BY 1, 2) JOIN bridge USING (gene) GROUP BY 1, 2),
  z AS (SELECT tissue, program, 'r' AS side, coalesce((v - avg(v) OVER w) / nullif(round(stddev_pop(v) OVER w, 12), 0), 0) AS z FROM rna WINDOW w AS (PARTITION BY program) UNION ALL SELECT tissue, program, 'p', coalesce((v - avg(v) OVER w) / nullif(round(stddev_pop(v) OVER w, 12), 0), 0) FROM prot WINDOW w AS (PARTITION BY program)),
  j AS (SELECT a.program, round(a.z, 9) AS x, round(b.z, 9) AS y FROM z a JOIN z b ON a.side = 'r' AND b.side = 'p' AND a.tissue = b.tissue AND a.program = b.program),
  k AS (SELECT *, rank() OVER (PARTITION BY program ORDER BY x) + (count(*) OVER (PARTITION BY program, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY program ORDER BY y) + (count(*) OVER (PARTITION BY program, y) - 1) / 2.0 AS ry FROM j)
  SELECT program, count(*) AS n, CASE WHEN count(*) >= 3 THEN {r('corr(x, y)', 5)} END AS pearson, CASE WHEN count(*) >= 3 THEN {r('corr(rx, ry)', 5)} END AS spearman FROM k GROUP BY 1""")
def rna_protein_agreement(spark, folder):
    rna = scored(spark, folder).where("tissue IS NOT NULL AND score IS NOT NULL").groupBy("tissue", "program").agg(F.avg("score").alias("value"))
    gene = proteins(spark, folder).groupBy("tissue", "gene").agg(F.avg("value").alias("v"))
    prot = gene.join(bridge(spark, folder), "gene").groupBy("tissue", "program").agg(F.avg("v").alias("value"))
    a, b = (matrix.row_zscores(x, "program").select("program", "tissue", F.round("z", 9).alias("score")) for x in (rna, prot))
    return show(stats.agreement(a, b, ["program"], key="tissue"), pearson=5, spearman=5)


# pseudobulk and spots ---------------------------------------------------------------------------------------
_PB = f"WITH {_LINES}, g AS (SELECT cell_type || '|' || compartment || '|' || donor AS pseudobulk_id, count(*) AS n_cells FROM assay GROUP BY 1 HAVING count(*) >= 20)"


@query(f"{_PB}, c AS (SELECT cell_id, cell_type || '|' || compartment || '|' || donor AS pseudobulk_id FROM assay) SELECT pseudobulk_id, gene, {r('sum(value)')} AS value FROM lines JOIN c USING (cell_id) WHERE pseudobulk_id IN (SELECT pseudobulk_id FROM g) GROUP BY 1, 2")
def pseudobulk_counts(spark, folder):
    c, counts = cells_of_lines(spark, folder)
    return show(pseudobulk.pseudobulk(counts, c, ["cell_type", "compartment", "donor"]))


@query(f"{_PB} SELECT pseudobulk_id, n_cells FROM g")
def pseudobulk_min_cells(spark, folder):
    return pseudobulk.pseudobulk_groups(cells_of_lines(spark, folder)[0], ["cell_type", "compartment", "donor"]).select("pseudobulk_id", "n_cells")


@query(f"WITH {_LINES}, m AS (SELECT cell_type AS sample_id, gene, sum(value) AS value FROM lines JOIN assay USING (cell_id) GROUP BY 1, 2), t AS (SELECT sample_id, sum(value) AS total FROM m WHERE gene LIKE '%RING' GROUP BY 1), a AS (SELECT sample_id, sum(value) AS total FROM m GROUP BY 1) SELECT m.sample_id, gene, {r('ln(1 + value * 1e6 / t.total)')} AS subset_cpm, {r('ln(1 + value * 1e6 / a.total)')} AS all_cpm FROM m JOIN t USING (sample_id) JOIN a USING (sample_id) WHERE gene LIKE '%RING'")
def log_cpm_both(spark, folder):
    c, counts = cells_of_lines(spark, folder)
    m = counts.join(c, "cell_id").groupBy(F.col("cell_type").alias("sample_id"), "gene").agg(F.sum("value").alias("value"))
    some = m.where("gene LIKE '%RING'")
    totals = m.groupBy("sample_id").agg(F.sum("value").alias("total"))
    both = matrix.log_cpm(some).withColumnRenamed("log_cpm", "subset_cpm").join(matrix.log_cpm(some, totals).select("sample_id", "gene", F.col("log_cpm").alias("all_cpm")), ["sample_id", "gene"])
    return show(both.select("sample_id", "gene", "subset_cpm", "all_cpm"))


@query(f"""WITH counts AS (SELECT l_suppkey AS barcode, upper(p_name) AS gene, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), b AS (SELECT DISTINCT string_split(upper(p_name), ' ')[-1] AS program, upper(p_name) AS gene FROM part), t AS (SELECT barcode, sum(value) AS total FROM counts GROUP BY 1), n AS (SELECT program, count(*) AS n FROM b WHERE gene IN (SELECT gene FROM counts) GROUP BY 1),
  s AS (SELECT barcode, program, sum(ln(1 + value * 1e6 / total)) AS v FROM counts JOIN t USING (barcode) JOIN b USING (gene) GROUP BY 1, 2) SELECT t.barcode, n.program, {r('coalesce(v, 0) / n')} AS score, s_nationkey AS array_row FROM t CROSS JOIN n LEFT JOIN s ON s.barcode = t.barcode AND s.program = n.program JOIN supplier ON s_suppkey = t.barcode WHERE s_nationkey % 2 = 1""")
def spot_scores(spark, folder):
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), F.upper("p_name").alias("gene"))
    counts = table(spark, folder, "lineitem").join(part, "l_partkey").groupBy(F.col("l_suppkey").alias("barcode"), "gene").agg(F.sum("l_quantity").alias("value"))
    b = part.select(F.element_at(F.split("gene", " "), -1).alias("program"), "gene").distinct()
    at = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("barcode"), F.col("s_nationkey").alias("array_row"), (F.col("s_nationkey") % 2).alias("in_tissue"))
    return show(spatial.spot_scores(counts, b, at).select("barcode", "program", "score", "array_row"))


# classification ---------------------------------------------------------------------------------------------
_FOLDS = f"f AS (SELECT sample_id, tissue, CAST(('0x' || md5('42|' || coalesce(subject_id, ''))[1:8])::BIGINT % 5 AS INTEGER) AS fold FROM meta WHERE tissue IS NOT NULL)"
_MAJ = f"{_FOLDS}, n AS (SELECT t.fold, f.tissue, count(*) AS m FROM f JOIN (SELECT DISTINCT fold FROM f) t ON f.fold <> t.fold GROUP BY 1, 2), best AS (SELECT fold, tissue AS predicted FROM n QUALIFY row_number() OVER (PARTITION BY fold ORDER BY m DESC, tissue) = 1), pr AS (SELECT f.*, predicted FROM f JOIN best USING (fold))"


def _majority(spark, folder):
    m = metadata(spark, folder).where("tissue IS NOT NULL").select("sample_id", "tissue", "subject_id")
    return classify.majority_predictions(classify.grouped_folds(m, "subject_id", 5), "tissue")


@query(f"WITH {_META}, {_FOLDS} SELECT sample_id, fold FROM f")
def grouped_folds(spark, folder):
    return classify.grouped_folds(metadata(spark, folder).where("tissue IS NOT NULL"), "subject_id", 5).select("sample_id", "fold")


@query(f"WITH {_META}, {_MAJ}, c AS (SELECT tissue, predicted, count(*) AS n FROM pr GROUP BY 1, 2) SELECT tissue, predicted, n, {r('n / sum(n) OVER (PARTITION BY tissue)')} AS share FROM c")
def confusion_norm(spark, folder):
    return show(classify.confusion(_majority(spark, folder), "tissue"))


@query(f"""WITH {_META}, {_MAJ}, t AS (SELECT fold, tissue AS c, count(*) AS nt, count_if(tissue = predicted) AS hit FROM pr GROUP BY 1, 2), g AS (SELECT fold, predicted AS c, count(*) AS np FROM pr GROUP BY 1, 2), j AS (SELECT fold, c, coalesce(nt, 0) AS nt, coalesce(hit, 0) AS hit, coalesce(np, 0) AS np FROM t FULL JOIN g USING (fold, c)),
  s AS (SELECT *, coalesce(2.0 * hit / nullif(nt + np, 0), 0) AS f1 FROM j) SELECT fold, CAST(sum(nt) AS BIGINT) AS n, {r('sum(hit) / sum(nt)')} AS accuracy, {r('avg(hit / nt) FILTER (nt > 0)')} AS balanced_accuracy, {r('avg(f1)')} AS macro_f1, {r('sum(f1 * nt) / sum(nt)')} AS weighted_f1 FROM s GROUP BY 1""")
def cv_metrics(spark, folder):
    return show(classify.metrics(_majority(spark, folder), "tissue", by=["fold"]))


def _cv(spark, folder, models):
    slugs = [slug_text(p) for p in PROGRAM_ORDER]
    wide = scored_wide(spark, folder).select("sample_id", *slugs)
    m = text.map_label(metadata(spark, folder).where("tissue IS NOT NULL"), "tissue", text.TISSUE_SYSTEM, "system", "Other")
    data = classify.grouped_folds(m.select("sample_id", "subject_id", "system").join(wide, "sample_id"), "subject_id", 5)
    return classify.cross_validate(data, slugs, "system", models)


@query()
def logreg_cv(spark, folder):
    """Metrics of the balanced multinomial regression on each donor-grouped fold."""
    return _cv(spark, folder, ["logistic"])


@query()
def model_comparison(spark, folder):
    """Fold summaries of all models and the best by macro F1."""
    s = classify.fold_summary(_cv(spark, folder, list(classify.MODELS)), ["model"])
    best = classify.best_per(s.withColumn("task", F.lit("system")), ["task"], "mean_macro_f1", "model").select(F.col("model").alias("best"))
    return show(s.join(F.broadcast(best)).withColumn("is_best", F.col("model") == F.col("best")).drop("best"))


# decomposition ----------------------------------------------------------------------------------------------
def _genes(spark, folder):
    return sorted(c.upper() for c in table(spark, folder, EXPRESSION).columns if c != "sample_id")


@query()
def pca_coords(spark, folder):
    """First five principal coordinates (absolute values) of every sample."""
    rows = decompose.feature_rows(matrix.zscores_by_moments(cells(spark, folder)), _genes(spark, folder), "z")
    return decompose.pca(rows, 5)[1].select("sample_id", *[rounded(F.abs(F.col("coords")[i]), 4).alias(f"pc{i + 1}") for i in range(5)])


@query()
def pca_loadings(spark, folder):
    """The ten strongest genes on either side of each component, and the variance explained."""
    genes = _genes(spark, folder)
    model, _ = decompose.pca(decompose.feature_rows(matrix.zscores_by_moments(cells(spark, folder)), genes, "z"), 5)
    top = summarize.top_two_sided(decompose.pca_loadings(spark, model, genes), ["component"], "loading", "gene", 10)
    return show(top.join(decompose.explained_variance(spark, model), "component"), loading=4, share=4, cumulative=4)


@query()
def nmf_modules(spark, folder):
    """The leading genes of the components of several factorisations fitted together."""
    genes = _genes(spark, folder)
    low = cells(spark, folder).groupBy("gene").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    scaled = cells(spark, folder).join(low, "gene").withColumn("value", F.coalesce(F.try_divide(F.col("value") - F.col("lo"), F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))), F.lit(0.0)))
    fitted = decompose.nmf(decompose.feature_rows(scaled, genes), [("k4_s1", 4, 1), ("k4_s2", 4, 2), ("k6_s1", 6, 1)], len(genes), rounds=8)
    top = summarize.top_k(decompose.component_table(spark, fitted, genes), ["model", "component"], [F.desc("weight"), F.col("gene")], 10)
    return show(top, weight=3)


@query()
def ward_clusters(spark, folder):
    """Tissues clustered by their programs' mean scores, per sex."""
    m = scored(spark, folder).where("score IS NOT NULL AND tissue IS NOT NULL").join(metadata(spark, folder).select("sample_id", "sex"), "sample_id").where("sex IS NOT NULL")
    mean = m.groupBy("sex", "tissue", "program").agg(F.avg("score").alias("v"))
    vec = mean.groupBy("sex", "tissue").agg(F.sort_array(F.collect_list(F.struct("program", "v"))).alias("s")).where(F.size("s") == len(PROGRAM_ORDER))
    return decompose.cluster_groups(vec.select("sex", "tissue", F.transform("s", lambda x: x["v"]).alias("vec")), "sex", "tissue", "vec", 5)


def _grouped(spark, folder):
    """Modules by their data set."""
    d = table(spark, folder, MODULES).where("module_id IS NOT NULL").groupBy("module_id").agg(F.max("dataset").alias("dataset"))
    return modules(spark, folder).select("module_id", F.array_distinct("items").alias("items")).join(d, "module_id").where("dataset IS NOT NULL AND size(items) > 0")


@query()
def module_clusters(spark, folder):
    """Modules of each data set consolidated by average linkage."""
    return show(consolidate.clustered_modules(_grouped(spark, folder), "dataset"), cophenetic=4)


@query()
def cluster_programs(spark, folder):
    """The clusters of each data set assigned to programs one to one."""
    m, static = _grouped(spark, folder), Scratch(spark, "clusters")
    c = static.save(consolidate.clustered_modules(m, "dataset"))
    return show(consolidate.assigned_programs(consolidate.cluster_program_scores(c, m, bridge(spark, folder), "dataset"), "dataset"), score=4)


# two vectors per program: the genes it shares with another, and the programs' score ranks
@query(f"""WITH {_BRIDGE}, {_SCORED}, k AS ({_RANK}), n AS (SELECT program, count(*) AS n FROM bridge GROUP BY 1), j AS (SELECT x.program AS a, y.program AS b, count(*) / (any_value(nx.n) + any_value(ny.n) - count(*)) AS jaccard FROM bridge x JOIN bridge y ON x.gene = y.gene AND x.program < y.program JOIN n nx ON nx.program = x.program JOIN n ny ON ny.program = y.program GROUP BY 1, 2),
  r AS (SELECT x.program AS a, y.program AS b, corr(x.rk, y.rk) AS s FROM k x JOIN k y ON x.sample_id = y.sample_id AND x.program < y.program GROUP BY 1, 2) SELECT a, b, {r('0.7 * coalesce(jaccard, 0) + 0.3 * greatest(coalesce(s, 0), 0)')} AS similarity FROM j FULL JOIN r USING (a, b)""")
def combined_program_similarity(spark, folder):
    o = genesets.overlaps(bridge(spark, folder).withColumnRenamed("program", "name"))
    return show(consolidate.combined_similarity(o, stats.pair_correlations(scored(spark, folder))))


# scans and streams ------------------------------------------------------------------------------------------
@query()
def table_profile(spark, folder):
    """Types, null counts and extremes of the metadata's columns."""
    return profile(table(spark, folder, METADATA))


@query(f"WITH {_CELLS}, {_BRIDGE}, {_MOMENTS} SELECT sample_id, program, CAST(count(*) AS INTEGER) AS n_genes, {r('avg(value)')} AS mean, {r('avg(z)')} AS zscore_mean FROM z JOIN bridge USING (gene) GROUP BY 1, 2")
def stream_scores(spark, folder):
    """The samples scored as a stream against static gene moments."""
    from matrixloom.streaming import scorer

    path = f"{folder}/{EXPRESSION}.parquet"
    genes = [c for c in table(spark, folder, EXPRESSION).columns if c != "sample_id"]
    static = Scratch(spark, "stream")
    moments = matrix.array_moments(matrix.row_matrix(table(spark, folder, EXPRESSION), "sample_id", genes), [g.upper() for g in genes])
    out = f"{static.at}/scores"
    stream = scorer.open_table_stream(spark, path).where("sample_id IS NOT NULL")
    scored_ = scorer.score_stream(stream, "sample_id", genes, bridge(spark, folder), moments)
    scorer.run_once(scored_, out)
    return show(spark.read.parquet(f"{out}/rows").dropDuplicates(["sample_id", "program"]))


@query(f"SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k, event_type, count(*) AS n, {r('sum(value)', 4)} AS total FROM events GROUP BY 1, 2")
def json_projection(spark, folder):
    e = table(spark, folder, "events").withColumn("k", F.from_json("props", "k INT")["k"])
    return show(e.groupBy("k", "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")), total=4)


@query(f"SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, {r('sum(value)', 4)} AS total FROM events GROUP BY 1, 2")
def event_windows(spark, folder):
    from matrixloom.streaming import scorer

    return show(scorer.event_windows(table(spark, folder, "events"), "ts", "event_type", "value"), total=4)

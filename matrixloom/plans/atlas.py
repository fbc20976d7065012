"""Queries of annotation, lookup, source and report tables, each with the same query as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from matrixloom.functions import text
from matrixloom.functions.numbers import rounded
from matrixloom.operators import atlas, genesets, matrix, order, packed, pseudobulk, stats, summarize
from matrixloom.operators.wide import clean_symbol
from matrixloom.plans import core
from matrixloom.plans.core import _BRIDGE, _CELLS, _LINES, _MATCH, _META, _MODULES, _MOMENTS, _PROTEINS, _RANKED, _SCORED, _SUPPORT, _TISSUE, SQL, bridge, cells, cells_of_lines, metadata, modules, proteins, query, r, scored, show
from matrixloom.plans.tables import EXPRESSION, METADATA, MODULES, PROTEOMICS, table
from matrixloom.schema import PROGRAM_ORDER, slug_text
from matrixloom.sources import readers


# annotation and metadata ------------------------------------------------------------------------------------
@query("""SELECT division, category, gene FROM (SELECT string_split(p_name, ' ')[1] AS division, p_type AS category, upper(regexp_replace(p_name, '^\\s+|\\s+$', '', 'g')) AS gene FROM part)
  WHERE gene NOT IN ('', 'NAN', 'NONE') QUALIFY row_number() OVER (PARTITION BY gene ORDER BY division, category) = 1""")
def annotation_clean(spark, folder):
    p = table(spark, folder, "part").select(F.split("p_name", " ")[0].alias("first"), "p_type", "p_name")
    return atlas.annotation(p, "first", "p_type", "p_name")


_SUBJECTS = f"""subjects AS (SELECT subject_id, sex, age, death_hardy_score FROM {METADATA} WHERE subject_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY loaded_at DESC NULLS LAST, sex DESC NULLS LAST, age DESC NULLS LAST, death_hardy_score DESC NULLS LAST) = 1)"""


@query(f"WITH {_SUBJECTS} SELECT subject_id, CAST(sex AS VARCHAR) AS sex, age, death_hardy_score FROM subjects")
def subject_metadata(spark, folder):
    s = atlas.latest_per(table(spark, folder, METADATA), "subject_id", ["sex", "age", "death_hardy_score"], "loaded_at")
    return s.withColumn("sex", F.col("sex").cast("string"))


@query(f"""WITH {_CELLS}, {_META}, {_SUBJECTS}, s AS (SELECT DISTINCT sample_id FROM cells), j AS (SELECT sample_id, tissue, coalesce(subject_id, CASE WHEN sample_id LIKE 'GTEX-%' THEN array_to_string(string_split(sample_id, '-')[1:2], '-') ELSE '' END) AS subject_id FROM s LEFT JOIN meta USING (sample_id))
  SELECT sample_id, subject_id, tissue, CAST(sex AS VARCHAR) AS sex, age, death_hardy_score FROM j LEFT JOIN subjects USING (subject_id)""")
def sample_subject_join(spark, folder):
    s = table(spark, folder, EXPRESSION).select("sample_id").where("sample_id IS NOT NULL").distinct()
    own = metadata(spark, folder).select("sample_id", "tissue", "subject_id")
    return atlas.joined_metadata(s, own, subject_metadata(spark, folder), text.subject_id(F.col("sample_id"))).select("sample_id", "subject_id", "tissue", "sex", "age", "death_hardy_score")


@query(f"SELECT upper(p_name) AS gene, {r('sum(l_quantity)')} AS total FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'O' GROUP BY 1")
def chosen_layer_totals(spark, folder):
    """Counts of the preferred layer: open lines stand for corrected counts, finished ones for raw counts."""
    names = F.when(F.col("l_linestatus") == "O", atlas.LAYERS[0]).otherwise(atlas.LAYERS[1])
    li = table(spark, folder, "lineitem").withColumn("layer", names)
    layer = atlas.choose_layer(sorted(x[0] for x in li.select("layer").distinct().collect()))
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), F.upper("p_name").alias("gene"))
    return show(li.where(F.col("layer") == layer).join(part, "l_partkey").groupBy("gene").agg(F.sum("l_quantity").alias("total")))


@query(f"WITH {_CELLS}, {_META}, {_BRIDGE} SELECT sample_id, gene, {r('log2(value + 1)')} AS value FROM cells WHERE gene IN (SELECT gene FROM bridge) AND sample_id IN (SELECT sample_id FROM meta WHERE sex = 1)")
def selected_genes_samples(spark, folder):
    return show(atlas.selected_cells(cells(spark, folder), bridge(spark, folder), metadata(spark, folder).where("sex = 1")))


@query(f"WITH {_PROTEINS}, a AS (SELECT condition, entered, tissue, gene, avg(value) AS v FROM proteins GROUP BY 1, 2, 3, 4) SELECT condition, tissue, gene, {r('avg(v)')} AS value FROM a GROUP BY 1, 2, 3")
def protein_matrix(spark, folder):
    """Tissues of one name are averaged without weights after their own means."""
    own = proteins(spark, folder).groupBy("condition", "entered", "tissue", "gene").agg(F.avg("value").alias("v"))
    return show(own.groupBy("condition", "tissue", "gene").agg(F.avg("v").alias("value")))


@query(f"WITH {_BRIDGE} SELECT program, count(*) AS n_genes, string_agg(gene, ', ' ORDER BY gene) AS genes FROM bridge GROUP BY 1")
def supplementary_programs(spark, folder):
    b = bridge(spark, folder).groupBy("program").agg(F.count("*").alias("n_genes"), F.array_sort(F.collect_list("gene")).alias("g"))
    return b.select("program", "n_genes", F.array_join("g", ", ").alias("genes"))


_SYSTEMS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.TISSUE_SYSTEM.items())


@query(f"""WITH {_META}, {_PROTEINS}, d AS (SELECT DISTINCT tissue_detail AS sample, lower(trim(tissue_detail)) AS t FROM meta WHERE tissue_detail IS NOT NULL), c AS (SELECT DISTINCT sample_type AS sample, lower(trim(sample_type)) AS t FROM proteins WHERE sample_type IS NOT NULL)
  SELECT 'tissues' AS dataset, tissue AS sample, CASE tissue {_SYSTEMS} ELSE 'unknown' END AS label FROM (SELECT DISTINCT tissue FROM meta WHERE tissue IS NOT NULL) UNION ALL SELECT 'details', sample, {core._case(text.DETAIL_SYSTEM_RULES, 'unknown')} FROM d
  UNION ALL SELECT 'brain', sample, {core._case(text.BRAIN_REGION_RULES, 'unknown')} FROM d UNION ALL SELECT 'sample_types', sample, {core._case(text.CELL_LINEAGE_RULES, 'unknown')} FROM c""")
def mapped_labels(spark, folder):
    """Labels of several data sets, each by its own mapper."""
    kinds = [("tissues", metadata(spark, folder), "tissue", "tissue"), ("details", metadata(spark, folder), "tissue_detail", "detail"), ("brain", metadata(spark, folder), "tissue_detail", "brain"), ("sample_types", proteins(spark, folder), "sample_type", "cell")]
    parts = [text.sample_labels(df, c, kind).select(F.lit(name).alias("dataset"), "sample", "label") for name, df, c, kind in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_FEW = r"CASE WHEN lower(s) IN ('fallopian tube') THEN 'Fallopian Tube' WHEN lower(s) = 'blood vessel' THEN 'Blood Vessel' WHEN lower(s) = 'retina' THEN 'Eye' WHEN regexp_full_match(lower(s), 'skin|stomach|colon|kidney|lung|liver|ovary|prostate|breast|tooth|omentum|eye') THEN upper(s[1:1]) || lower(s[2:]) ELSE s END"


@query(rf"SELECT DISTINCT tissue AS entered, {_TISSUE('tissue')} AS name, {_FEW} AS few FROM (SELECT tissue, regexp_replace(tissue, '^\s+|\s+$', '', 'g') AS s FROM {PROTEOMICS} WHERE tissue IS NOT NULL)")
def tissue_names(spark, folder):
    t = table(spark, folder, PROTEOMICS).where("tissue IS NOT NULL").select(F.col("tissue").alias("entered")).distinct()
    return t.select("entered", text.tissue_name(F.col("entered")).alias("name"), text.tissue_name(F.col("entered"), few=True).alias("few"))


def _raw_modules(spark, folder):
    return packed.one_list_per_key(table(spark, folder, MODULES), "module_id", ["dataset", "feature_set", "component", "module_name", "ecm_program_curated", "confidence", "top_samples", "top_genes"], latest="loaded_at")


_RAW = f"raw AS (SELECT * FROM {MODULES} WHERE module_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY module_id ORDER BY loaded_at DESC NULLS LAST) = 1)"


@query(f"""WITH {_RAW}, names AS (SELECT feature_set, component, min(module_name) AS label FROM raw WHERE confidence = 'High' AND module_name IS NOT NULL GROUP BY 1, 2)
  SELECT module_id, feature_set, component, coalesce(label, 'Unannotated module') AS label FROM raw LEFT JOIN names USING (feature_set, component)""")
def annotation_lookup(spark, folder):
    """The names of well annotated components for every module of the same feature set and component."""
    m = _raw_modules(spark, folder)
    names = m.where("confidence = 'High' AND module_name IS NOT NULL").select("feature_set", "component", F.col("module_name").alias("label"))
    return atlas.looked_up(m.select("module_id", "feature_set", "component"), names, ["feature_set", "component"], "label", "Unannotated module")


@query(f"""WITH {_RAW}, names AS (SELECT feature_set, component, min(ecm_program_curated) AS program FROM raw WHERE confidence IN ('High', 'Moderate-high') GROUP BY 1, 2)
  SELECT module_id, dataset, feature_set, component, module_name, coalesce(program, 'Unassigned/specialized ECM') AS program, confidence, {core._CONF} AS confidence_score FROM raw LEFT JOIN names USING (feature_set, component)""")
def curated_long_table(spark, folder):
    m = _raw_modules(spark, folder)
    curated = m.where("confidence IN ('High', 'Moderate-high')").select("feature_set", "component", F.col("ecm_program_curated").alias("program"))
    long = atlas.looked_up(m, curated, ["feature_set", "component"], "program", "Unassigned/specialized ECM").withColumn("confidence_score", text.confidence_score(F.col("confidence")))
    return long.select("module_id", "dataset", "feature_set", "component", "module_name", "program", "confidence", "confidence_score")


_STRIP = lambda c: rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


@query(f"SELECT concat_ws(' | ', {_STRIP('tissue')}, {_STRIP('sample_type')}, {_STRIP('repository')}) AS sample_key, count(*) AS n FROM {PROTEOMICS} GROUP BY 1")
def composite_ids(spark, folder):
    key = atlas.composite_id(F.col("tissue"), F.col("sample_type"), F.col("repository"))
    return table(spark, folder, PROTEOMICS).groupBy(key.alias("sample_key")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderpriority AS compartment, c_mktsegment AS cell_type, CAST(c_nationkey AS VARCHAR) AS donor, count(*) AS n_cells FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1, 2, 3""")
def filtered_cells(spark, folder):
    o = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    obs = o.select(F.col("o_orderkey").alias("cell_id"), F.col("o_orderstatus").alias("method"), F.col("c_nationkey").alias("donor"), F.col("c_mktsegment").alias("cell_type"), F.col("o_orderpriority").alias("compartment"))
    return atlas.observed_cells(obs, ["method", "donor", "cell_type", "compartment"], "F").groupBy("compartment", "cell_type", "donor").agg(F.count("*").alias("n_cells"))


@query(f"WITH {_PROTEINS} SELECT tissue, count(*) AS n, count(DISTINCT gene) AS n_genes, count(DISTINCT run_id) AS n_runs, count(DISTINCT sample_type) AS n_sample_types, count(DISTINCT repository) AS n_repositories, {r('avg(value)')} AS mean_value, {r('median(value)')} AS median_value, {r('max(value)')} AS max_value FROM proteins GROUP BY 1")
def tissue_summary(spark, folder):
    p = proteins(spark, folder)
    totals = p.groupBy("tissue").agg(
        F.count("*").alias("n"), *[F.count_distinct(c).alias(f"n_{n}") for c, n in (("gene", "genes"), ("run_id", "runs"), ("sample_type", "sample_types"), ("repository", "repositories"))],
        F.avg("value").alias("mean_value"), F.max("value").alias("max_value"),
    )
    return show(totals.join(order.quantiles(p, ["tissue"], "value", [0.5]).select("tissue", F.col("q0").alias("median_value")), "tissue"))


@query(f"WITH {_CELLS}, {_META} SELECT tissue_detail, gene, {r('avg(value)')} AS mean, count(*) AS n FROM cells JOIN meta USING (sample_id) WHERE tissue_detail IS NOT NULL GROUP BY 1, 2")
def detail_gene_means(spark, folder):
    return show(_details(spark, folder).select("tissue_detail", "gene", F.col("value").alias("mean"), "n"))


def _details(spark, folder):
    m = metadata(spark, folder).where("tissue_detail IS NOT NULL").select("sample_id", "tissue_detail")
    return cells(spark, folder).join(m, "sample_id").groupBy("tissue_detail", "gene").agg(F.avg("value").alias("value"), F.count("*").alias("n"))


@query(f"WITH {_CELLS}, {_META}, d AS (SELECT tissue_detail, gene, avg(value) AS v FROM cells JOIN meta USING (sample_id) WHERE tissue_detail IS NOT NULL GROUP BY 1, 2) SELECT x.tissue_detail AS a, y.tissue_detail AS b, {r('corr(x.v, y.v)')} AS pearson FROM d x JOIN d y ON x.gene = y.gene AND x.tissue_detail < y.tissue_detail GROUP BY 1, 2")
def sample_correlations(spark, folder):
    """Correlations of the tissues' mean profiles over the genes."""
    c = stats.pair_correlations(_details(spark, folder), item="tissue_detail", sample="gene", value="value")
    return show(c.select("a", "b", "pearson"))


@query(f"""WITH {_CELLS}, {_META} SELECT 'expression' AS dataset, count(DISTINCT sample_id) AS n_samples, count(DISTINCT gene) AS n_genes, count(*) AS n_cells FROM cells
  UNION ALL SELECT 'proteomics', count(DISTINCT run_id), count(DISTINCT gene), count(*) FROM (SELECT DISTINCT run_id, gene FROM (WITH {_PROTEINS} SELECT * FROM proteins) WHERE run_id IS NOT NULL)""")
def configured_datasets(spark, folder):
    """The matrices of all configured data sets, wide and long ones, by one loader."""
    configs = [
        readers.DatasetConfig("expression", f"{folder}/{EXPRESSION}.parquet", "sample_id"),
        readers.DatasetConfig("proteomics", f"{folder}/{PROTEOMICS}.parquet", "run_id", "gene_symbol", "log1p_nsaf", where="tissue IS NOT NULL AND record_id IS NOT NULL", one_of="record_id", latest="loaded_at"),
    ]
    parts = [
        readers.load_dataset(spark, c).agg(F.lit(c.name).alias("dataset"), F.count_distinct("sample_id").alias("n_samples"), F.count_distinct("gene").alias("n_genes"), F.count("*").alias("n_cells")) for c in configs
    ]
    return parts[0].unionByName(parts[1])


@query(f"""SELECT name, n IS NOT NULL AS found, coalesce(n, -1) AS n_rows, coalesce(k, -1) AS n_columns FROM (VALUES ('{METADATA}', (SELECT count(*) FROM {METADATA}), 13), ('{EXPRESSION}', (SELECT count(*) FROM {EXPRESSION}), 65), ('not_there', NULL, NULL)) t(name, n, k)""")
def inspected_tables(spark, folder):
    return readers.inspect(spark, {n: f"{folder}/{n}.parquet" for n in (METADATA, EXPRESSION, "not_there")}).select("name", "found", F.coalesce("n_rows", F.lit(-1)).alias("n_rows"), F.coalesce("n_columns", F.lit(-1)).alias("n_columns"))


@query(f"WITH {_CELLS}, {_BRIDGE}, s AS (SELECT 'all' AS feature_set, gene FROM cells GROUP BY gene UNION ALL SELECT program, gene FROM bridge WHERE gene IN (SELECT gene FROM cells)) SELECT feature_set, count(*) AS n_genes, string_agg(gene, ', ' ORDER BY gene) AS genes, (SELECT count(DISTINCT sample_id) FROM cells) AS n_samples FROM s GROUP BY 1")
def embedding_metadata(spark, folder):
    """What goes into the embedding of each feature set: samples, genes and their list."""
    c = cells(spark, folder)
    genes = c.select("gene").distinct()
    sets = genes.select(F.lit("all").alias("feature_set"), "gene").unionByName(bridge(spark, folder).join(genes, "gene", "left_semi").select(F.col("program").alias("feature_set"), "gene"))
    listed = sets.groupBy("feature_set").agg(F.count("*").alias("n_genes"), F.array_join(F.array_sort(F.collect_list("gene")), ", ").alias("genes"))
    return listed.crossJoin(c.agg(F.count_distinct("sample_id").alias("n_samples")))  # beside one row


# sources ----------------------------------------------------------------------------------------------------
_SOURCES = f"""{_LINES}, pb AS (SELECT cell_type || '|' || compartment || '|' || donor AS pseudobulk_id, cell_type, compartment, donor, count(*) AS n_cells FROM assay GROUP BY ALL HAVING count(*) >= 5),
  m AS (SELECT pseudobulk_id, gene, sum(value) AS value FROM lines JOIN assay USING (cell_id) JOIN pb USING (cell_type, compartment, donor) GROUP BY 1, 2), t AS (SELECT pseudobulk_id, sum(value) AS total FROM m GROUP BY 1),
  b AS (SELECT DISTINCT string_split(upper(p_name), ' ')[-1] AS program, upper(p_name) AS gene FROM part), s AS (SELECT pb.*, program, avg(ln(1 + value * 1e6 / total)) AS score FROM m JOIN t USING (pseudobulk_id) JOIN b USING (gene) JOIN pb USING (pseudobulk_id) GROUP BY ALL)"""


def _source_scores(spark, folder):
    c, counts = cells_of_lines(spark, folder)
    keys = ["cell_type", "compartment", "donor"]
    groups = pseudobulk.pseudobulk_groups(c, keys, 5)
    m = pseudobulk.pseudobulk(counts, c, keys, 5).withColumnRenamed("pseudobulk_id", "sample_id")
    b = table(spark, folder, "part").select(F.upper("p_name").alias("gene")).distinct().select(F.element_at(F.split("gene", " "), -1).alias("program"), "gene")
    s = matrix.log_cpm(m).join(b, "gene").groupBy(F.col("sample_id").alias("pseudobulk_id"), "program").agg(F.avg("log_cpm").alias("score"))
    return s.join(groups, "pseudobulk_id")


def _cell_summary_sql(groups):
    on = " AND ".join(f"s.{g} = c.{g}" for g in groups.split(", "))
    cols = ", ".join(f"s.{g}" for g in groups.split(", "))
    return f"""SELECT {cols}, program, n_pseudobulk, n_donors, n_cells_total, avg(score) AS mean_score, median(score) AS median_score, stddev_pop(score) AS std_score, quantile_cont(score, 0.25) AS q25_score, quantile_cont(score, 0.75) AS q75_score FROM s
      JOIN (SELECT {groups}, count(*) AS n_pseudobulk, count(DISTINCT donor) AS n_donors, CAST(sum(n_cells) AS BIGINT) AS n_cells_total FROM pb GROUP BY ALL) c ON {on} GROUP BY ALL"""


_FIGURES = ", ".join(f"{r(c)} AS {c}" for c in ("mean_score", "median_score", "std_score", "q25_score", "q75_score"))


@query(f"WITH {_SOURCES}, g AS ({_cell_summary_sql('compartment')}) SELECT compartment, program, n_pseudobulk, n_donors, n_cells_total, {_FIGURES} FROM g")
def cell_count_summary(spark, folder):
    return show(atlas.group_counts(_source_scores(spark, folder), ["compartment"]))


@query(f"WITH {_SOURCES}, g AS ({_cell_summary_sql('compartment, cell_type')}) SELECT compartment, cell_type, program, n_pseudobulk, n_donors, n_cells_total, {r('mean_score')} AS mean_score, CAST(row_number() OVER (PARTITION BY program ORDER BY round(mean_score, 9) DESC, compartment, cell_type) AS INTEGER) AS rank FROM g WHERE n_donors >= 2 AND n_pseudobulk >= 2 AND n_cells_total >= 100 QUALIFY rank <= 15")
def robust_sources(spark, folder):
    """The sources with the highest scores of each program among those with enough donors, pseudobulks and cells."""
    g = atlas.supported(atlas.group_counts(_source_scores(spark, folder), ["compartment", "cell_type"]))
    top = summarize.top_k(g, ["program"], [F.desc(F.round("mean_score", 9)), F.col("compartment"), F.col("cell_type")], 15)
    return show(top.select("compartment", "cell_type", "program", "n_pseudobulk", "n_donors", "n_cells_total", "mean_score", "rank"))


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(f"""WITH {_SOURCES}, g AS ({_cell_summary_sql('compartment')}) SELECT program, {', '.join(f'''{r(f"coalesce(avg(mean_score) FILTER (compartment = '{p}'), 0)")} AS "{p}"''' for p in _PRIORITIES)} FROM g GROUP BY 1""")
def compartment_matrix(spark, folder):
    g = atlas.group_counts(_source_scores(spark, folder), ["compartment"])
    wide = atlas.pivoted(g, "program", "compartment", "mean_score", _PRIORITIES, 0.0)
    return wide.select("program", *[rounded(F.col(f"`{p}`")).alias(p) for p in _PRIORITIES])


@query(f"WITH {_SOURCES}, g AS ({_cell_summary_sql('compartment, cell_type')}) SELECT program, compartment || ' | ' || cell_type AS source, {r('mean_score')} AS mean_score, CAST(row_number() OVER (PARTITION BY program ORDER BY round(mean_score, 9) DESC, compartment || ' | ' || cell_type) AS INTEGER) AS rank FROM g QUALIFY rank <= 30")
def organ_celltypes(spark, folder):
    g = atlas.group_counts(_source_scores(spark, folder), ["compartment", "cell_type"]).withColumn("source", F.concat_ws(" | ", "compartment", "cell_type"))
    return show(summarize.top_k(g, ["program"], [F.desc(F.round("mean_score", 9)), F.col("source")], 30).select("program", "source", "mean_score", "rank"))


@query(f"WITH c AS ({SQL['cross_method_consensus']}), k AS (SELECT *, row_number() OVER (PARTITION BY program ORDER BY consensus DESC, best_rank, round(max_score, 6) DESC, item) AS place FROM c) SELECT program, count(*) AS n_items, CAST(count_if(consensus) AS BIGINT) AS n_consensus, coalesce(string_agg(CASE WHEN consensus AND place <= 5 THEN item END, '; ' ORDER BY place), '') AS consensus_items, string_agg(CASE WHEN place <= 8 THEN printf('%s (%.2f)', item, {r('max_score', 2)}) END, '; ' ORDER BY place) AS top_items FROM k GROUP BY 1")
def source_report(spark, folder):
    return atlas.source_report(core.cross_method_consensus(spark, folder))


# modules ----------------------------------------------------------------------------------------------------
@query(f"{_MATCH}, d AS (SELECT module_id AS a, max(dataset) AS dataset FROM {MODULES} WHERE module_id IS NOT NULL GROUP BY 1) SELECT b AS program, count(*) AS n_modules, count(DISTINCT dataset) AS n_datasets, array_to_string(list_sort(list(DISTINCT dataset) FILTER (dataset IS NOT NULL)), '; ') AS datasets, count(DISTINCT feature_set) AS n_feature_sets, array_to_string(list_sort(list(DISTINCT feature_set) FILTER (feature_set IS NOT NULL)), '; ') AS feature_sets, {r('avg(o)')} AS mean_overlap, {r('avg(j)')} AS mean_jaccard, {r('avg(n)')} AS mean_common FROM best JOIN d USING (a) JOIN modules ON module_id = a WHERE n >= 4 AND o >= 0.13 GROUP BY 1")
def reproducibility_rollup(spark, folder):
    m = modules(spark, folder)
    best = genesets.best_match(genesets.overlaps(m.select(F.col("module_id").alias("name"), F.explode("items").alias("gene")), bridge(spark, folder).withColumnRenamed("program", "name")))
    d = table(spark, folder, MODULES).where("module_id IS NOT NULL").groupBy(F.col("module_id").alias("a")).agg(F.max("dataset").alias("dataset"))
    return show(atlas.reproducibility(best.join(d, "a").join(m.select(F.col("module_id").alias("a"), "feature_set"), "a")))


_TOPS = f"{_RAW}, tops AS (SELECT module_id, unnest(list_filter(list_transform(string_split(coalesce(top_samples, ''), ';'), lambda x: trim(x)), lambda x: x <> '')) AS tissue FROM raw)"


@query(f"""WITH {_MODULES}, {_TOPS}, gf AS (SELECT ecm_program_curated AS program, gene, count(*) AS c FROM items JOIN modules USING (module_id) GROUP BY 1, 2), tf AS (SELECT ecm_program_curated AS program, tissue, count(*) AS c FROM tops JOIN modules USING (module_id) GROUP BY 1, 2),
  gl AS (SELECT program, string_agg(gene, ', ' ORDER BY rn) AS top_genes FROM (SELECT *, row_number() OVER (PARTITION BY program ORDER BY c DESC, gene) AS rn FROM gf QUALIFY rn <= 30) GROUP BY 1), tl AS (SELECT program, string_agg(tissue, '; ' ORDER BY rn) AS top_tissues FROM (SELECT *, row_number() OVER (PARTITION BY program ORDER BY c DESC, tissue) AS rn FROM tf QUALIFY rn <= 15) GROUP BY 1)
  SELECT p.*, (SELECT count(*) FROM gf WHERE gf.program = p.program) AS n_genes, top_genes, top_tissues FROM (SELECT ecm_program_curated AS program, count(*) AS n_modules, count(DISTINCT feature_set) AS n_feature_sets, coalesce(array_to_string(list_sort(list(DISTINCT feature_set) FILTER (feature_set IS NOT NULL)), '; '), '') AS feature_sets FROM modules WHERE ecm_program_curated IS NOT NULL GROUP BY 1) p LEFT JOIN gl USING (program) LEFT JOIN tl USING (program)""")
def cluster_summary(spark, folder):
    """Modules grouped by their curated program, with the group's most frequent genes and tissues."""
    m = modules(spark, folder).where("ecm_program_curated IS NOT NULL").select("module_id", F.col("ecm_program_curated").alias("program"), "feature_set", "items")
    t = _raw_modules(spark, folder).select("module_id", text.split_items(F.col("top_samples"), ";", upper=False).alias("tissues"))
    return atlas.cluster_summary(m.join(t, "module_id"), "program", "items", "tissues")


@query(f"""WITH {_MODULES}, {_TOPS}, g AS (SELECT DISTINCT ecm_program_curated AS program, gene FROM items JOIN modules USING (module_id) WHERE item_pos <= 10), t AS (SELECT DISTINCT program, {_FEW} AS tissue FROM (SELECT ecm_program_curated AS program, tissue AS s FROM tops JOIN modules USING (module_id)))
  SELECT program, count(*) AS n_modules, CAST((SELECT count(*) FROM g WHERE g.program = m.program) AS INTEGER) AS n_genes, coalesce((SELECT string_agg(gene, ', ' ORDER BY gene) FROM g WHERE g.program = m.program), '') AS genes,
  CAST((SELECT count(*) FROM t WHERE t.program = m.program) AS INTEGER) AS n_tissues, coalesce((SELECT string_agg(tissue, '; ' ORDER BY tissue) FROM t WHERE t.program = m.program), '') AS tissues FROM (SELECT ecm_program_curated AS program FROM modules WHERE ecm_program_curated IS NOT NULL) m GROUP BY 1""")
def program_tissue_sets(spark, folder):
    """The first ten genes of each module and its top tissues, united by program."""
    return atlas.program_sets_with_tissues(_with_tissues(spark, folder), "ecm_program_curated", "items", "tissues", 10)


def _with_tissues(spark, folder):
    t = _raw_modules(spark, folder).select("module_id", F.transform(text.split_items(F.col("top_samples"), ";", upper=False), lambda x: text.tissue_name(x, few=True)).alias("tissues"))
    return modules(spark, folder).join(t, "module_id")


@query(f"""WITH {_MODULES}, {_TOPS}, l AS (SELECT module_id, string_agg(gene, ', ' ORDER BY item_pos) AS genes FROM items WHERE item_pos <= 10 GROUP BY 1), t AS (SELECT module_id, array_to_string(list_filter(list_transform(string_split(coalesce(top_samples, ''), ';'), lambda x: trim(x)), lambda x: x <> ''), '; ') AS samples FROM raw)
  SELECT m.module_id, feature_set, module_name, coalesce(genes, '') AS genes, samples FROM modules m LEFT JOIN l USING (module_id) JOIN t USING (module_id)""")
def module_summary(spark, folder):
    t = _raw_modules(spark, folder).select("module_id", F.array_join(text.split_items(F.col("top_samples"), ";", upper=False), "; ").alias("samples"))
    m = modules(spark, folder).select("module_id", "feature_set", "module_name", F.array_join(F.slice(F.coalesce("items", F.array().cast("array<string>")), 1, 10), ", ").alias("genes"))
    return m.join(t, "module_id")


_SETS = ", ".join(f"('{n}', [{', '.join(repr(g) for g in v)}])" for n, v in atlas.REFERENCE_SETS.items())


@query(f"WITH {_PROTEINS}, b AS (SELECT name AS program, unnest(genes) AS gene FROM (VALUES {_SETS}) t(name, genes)), g AS (SELECT DISTINCT gene FROM proteins) SELECT program, count(*) AS n_genes, count(g.gene) AS n_available, {r('count(g.gene) / count(*)')} AS fraction FROM b LEFT JOIN g USING (gene) GROUP BY 1")
def reference_sets(spark, folder):
    """The fixed gene sets beside the programs, and how many of their genes are measured."""
    rows = [(n, g) for n, v in atlas.REFERENCE_SETS.items() for g in v]
    b = spark.createDataFrame(rows, "program STRING, gene STRING")
    return show(genesets.availability(b, proteins(spark, folder).select("gene")).select("program", "n_genes", "n_available", "fraction"))


_PROT = f"""{_PROTEINS}, {_BRIDGE}, ab AS (SELECT 'all_samples' AS condition, tissue, gene, avg(value) AS v FROM proteins GROUP BY 2, 3 UNION ALL SELECT condition, tissue, gene, avg(value) FROM proteins WHERE condition = 'normal_like' GROUP BY 1, 2, 3),
  ps AS (SELECT condition, program, tissue, avg(v) AS score FROM ab JOIN bridge USING (gene) GROUP BY 1, 2, 3), {_RAW}, own AS (SELECT DISTINCT program, {_FEW} AS tissue, true AS own FROM (SELECT ecm_program_curated AS program, unnest(list_filter(list_transform(string_split(coalesce(top_samples, ''), ';'), lambda x: trim(x)), lambda x: x <> '')) AS s FROM raw)),
  top AS (SELECT *, row_number() OVER (PARTITION BY condition, program ORDER BY round(score, 9) DESC, tissue) AS rank FROM ps QUALIFY rank <= 10),
  tt AS (SELECT condition, program, string_agg(tissue, '; ' ORDER BY rank) AS top_tissues, count(own) AS n_common, coalesce(string_agg(CASE WHEN own THEN tissue END, '; ' ORDER BY rank), '') AS common_tissues, avg(score) AS mean_top, max(score) AS max_top FROM top LEFT JOIN own USING (program, tissue) GROUP BY 1, 2)"""


def _top_tissues(spark, folder):
    p = proteins(spark, folder)
    every = p.withColumn("condition", F.lit("all_samples")).unionByName(p.where("condition = 'normal_like'"))
    gene = every.groupBy("condition", "tissue", "gene").agg(F.avg("value").alias("v"))
    s = gene.join(bridge(spark, folder), "gene").groupBy("condition", "program", "tissue").agg(F.avg("v").alias("score"))
    own = _with_tissues(spark, folder).select(F.col("ecm_program_curated").alias("program"), F.explode("tissues").alias("tissue"))
    return atlas.top_tissue_overlap(s, own, ["condition"])


@query(f"WITH {_PROT} SELECT condition, program, top_tissues, n_common, common_tissues, {r('mean_top')} AS mean_top, {r('max_top')} AS max_top FROM tt")
def top_tissue_summary(spark, folder):
    return show(_top_tissues(spark, folder))


@query(f"""WITH {_PROT}, d AS (SELECT DISTINCT gene FROM proteins), s AS (SELECT program, count(*) AS n, count(d.gene) AS hit, count(d.gene) / count(*) AS f FROM bridge b LEFT JOIN d USING (gene) GROUP BY 1) SELECT s.program, n AS n_genes, hit AS n_available, {r('f')} AS fraction,
  CASE WHEN f >= 0.85 THEN 'very strong' WHEN f >= 0.7 THEN 'strong' WHEN f >= 0.5 THEN 'moderate' ELSE 'weak' END AS strength, coalesce(a.top_tissues, '') AS all_top, coalesce(x.top_tissues, '') AS normal_top, coalesce(a.common_tissues, '') AS all_common, coalesce(x.common_tissues, '') AS normal_common
  FROM s LEFT JOIN tt a ON a.program = s.program AND a.condition = 'all_samples' LEFT JOIN tt x ON x.program = s.program AND x.condition = 'normal_like'""")
def validation_summary(spark, folder):
    """Gene support of each program beside its top tissues over all and over normal samples; what is missing is blank."""
    support = core.protein_support(spark, folder).select("program", "n_genes", "n_available", "fraction", "strength")
    t = _top_tissues(spark, folder)
    for c, n in (("all_samples", "all"), ("normal_like", "normal")):
        one = t.where(F.col("condition") == c).select("program", F.col("top_tissues").alias(f"{n}_top"), F.col("common_tissues").alias(f"{n}_common"))
        support = support.join(one, "program", "left").na.fill("", [f"{n}_top", f"{n}_common"])
    return support


# report tables ----------------------------------------------------------------------------------------------
@query(f"""WITH {_CELLS}, {_BRIDGE}, {_META}, {_MOMENTS}, {_RANKED}, s AS (SELECT sample_id, program, round(avg(value), 9) AS a, round(avg(pct), 9) AS b, any_value(sex) AS sex FROM ranked JOIN bridge USING (gene) JOIN meta USING (sample_id) WHERE sex IN (1, 2) GROUP BY 1, 2),
  k AS (SELECT *, rank() OVER (PARTITION BY program, sex ORDER BY a) + (count(*) OVER (PARTITION BY program, sex, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY program, sex ORDER BY b) + (count(*) OVER (PARTITION BY program, sex, b) - 1) / 2.0 AS rb FROM s), g AS (SELECT program, sex, corr(ra, rb) AS c FROM k GROUP BY 1, 2)
  SELECT program, {r('avg(c) FILTER (sex = 1)', 5)} AS sex_1, {r('avg(c) FILTER (sex = 2)', 5)} AS sex_2 FROM g GROUP BY 1""")
def rank_vs_mean_table(spark, folder):
    """Rank correlations of mean and rank scores, programs by sex of the donor."""
    s = core.scores(spark, folder, ("mean", "rank_percentile")).join(metadata(spark, folder).where("sex IN (1, 2)").select("sample_id", F.concat(F.lit("sex_"), "sex").alias("sex")), "sample_id")
    a, b = (s.select("program", "sex", "sample_id", F.round(m, 9).alias("score")) for m in ("mean", "rank_percentile"))
    t = atlas.pivoted(stats.agreement(a, b, ["program", "sex"]), "program", "sex", "spearman", ["sex_1", "sex_2"])
    return show(t, sex_1=5, sex_2=5)


_CONDITIONS = ["disease_like", "normal_like", "uncertain"]


@query(f"""WITH {_PROTEINS}, {_BRIDGE}, {_SCORED}, rna AS (SELECT tissue, program, avg(score) AS v FROM scored WHERE tissue IS NOT NULL AND score IS NOT NULL GROUP BY 1, 2), prot AS (SELECT condition, tissue, program, avg(v) AS v FROM (SELECT condition, tissue, gene, avg(value) AS v FROM proteins GROUP BY 1, 2, 3) JOIN bridge USING (gene) GROUP BY 1, 2, 3),
  j AS (SELECT condition, a.program, round(a.v, 9) AS x, round(b.v, 9) AS y FROM rna a JOIN prot b USING (tissue, program)), k AS (SELECT *, rank() OVER (PARTITION BY condition, program ORDER BY x) + (count(*) OVER (PARTITION BY condition, program, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY condition, program ORDER BY y) + (count(*) OVER (PARTITION BY condition, program, y) - 1) / 2.0 AS ry FROM j),
  g AS (SELECT condition, program, CASE WHEN count(*) >= 3 THEN corr(rx, ry) END AS c FROM k GROUP BY 1, 2) SELECT program, {', '.join(f'''{r(f"avg(c) FILTER (condition = '{c}')", 5)} AS {c}''' for c in _CONDITIONS)} FROM g GROUP BY 1""")
def rna_protein_table(spark, folder):
    """Rank correlations of RNA and protein scores over the tissues, programs by condition."""
    rna = scored(spark, folder).where("tissue IS NOT NULL AND score IS NOT NULL").groupBy("tissue", "program").agg(F.round(F.avg("score"), 9).alias("score"))
    gene = proteins(spark, folder).groupBy("condition", "tissue", "gene").agg(F.avg("value").alias("v"))
    prot = gene.join(bridge(spark, folder), "gene").groupBy("condition", "tissue", "program").agg(F.round(F.avg("v"), 9).alias("score"))
    every = rna.crossJoin(F.broadcast(spark.createDataFrame([(c,) for c in _CONDITIONS], "condition STRING")))  # three fixed rows
    t = atlas.pivoted(stats.agreement(every, prot, ["condition", "program"], key="tissue"), "program", "condition", "spearman", _CONDITIONS)
    return show(t, **dict.fromkeys(_CONDITIONS, 5))


@query(f"{_MATCH} SELECT b AS program, {', '.join(f'''{r(f"avg(CASE WHEN n >= 4 AND o >= 0.13 THEN 1.0 ELSE 0.0 END) FILTER (feature_set = '{s}')")} AS {s}''' for s in core._SETS)} FROM best JOIN modules ON module_id = a GROUP BY 1")
def recovery_table(spark, folder):
    """Share of modules that match each program, by feature set."""
    m = modules(spark, folder)
    best = genesets.best_match(genesets.overlaps(m.select(F.col("module_id").alias("name"), F.explode("items").alias("gene")), bridge(spark, folder).withColumnRenamed("program", "name")))
    j = best.join(m.select(F.col("module_id").alias("a"), "feature_set"), "a").select(F.col("b").alias("program"), "feature_set", F.col("is_match").cast("double").alias("hit"))
    return show(atlas.pivoted(j, "program", "feature_set", "hit", core._SETS))


@query(f"WITH {_SCORED} SELECT tissue, {', '.join(f'''{r(f"coalesce(avg(score) FILTER (program = '{p}'), 0)")} AS {slug_text(p)}''' for p in PROGRAM_ORDER)} FROM scored WHERE tissue IS NOT NULL AND score IS NOT NULL GROUP BY 1")
def tissue_program_matrix(spark, folder):
    """Tissues by programs in reporting order."""
    s = scored(spark, folder).where("tissue IS NOT NULL AND score IS NOT NULL").withColumn("program", text.slug(F.col("program")))
    return show(atlas.pivoted(s, "tissue", "program", "score", [slug_text(p) for p in PROGRAM_ORDER], 0.0))


@query(f"WITH {_CELLS}, k AS (SELECT gene AS component, sample_id, value, row_number() OVER (PARTITION BY gene ORDER BY value DESC, sample_id) AS rank FROM cells QUALIFY rank <= 5) SELECT component, string_agg(sample_id, '; ' ORDER BY rank) AS samples FROM k GROUP BY 1")
def top_samples_per_gene(spark, folder):
    t = summarize.top_k(cells(spark, folder), ["gene"], [F.desc("value"), F.col("sample_id")], 5)
    return t.groupBy(F.col("gene").alias("component")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "sample_id"))), lambda x: x["sample_id"]), "; ").alias("samples"))

"""Queries of the numbered problems that prepare training data, and their SQL where SQL can express them."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matrixloom.llm import canon, cluster, leak, lookalike, packing, quantiles, setpairs
from matrixloom.operators import packed
from matrixloom.plans import numbered
from matrixloom.plans.tables import EXPRESSION, METADATA, MODULES, PROTEOMICS, SCORES, SUMMARY, table
from matrixloom.schema import PROGRAM_ORDER, slug_text
from matrixloom.session import Scratch

FIELDS = ["tissue", "sample_type", "condition_group"]
SLUGS = {p: slug_text(p) for p in PROGRAM_ORDER}


# 1. clusters ----------------------------------------------------------------------------------------------
ALIKE = 0.85


def _p1(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str], DataFrame]:
    df = table(spark, folder, EXPRESSION)
    genes = [c for c in df.columns if c != "sample_id"]
    return df, genes, cluster.clusters(df, "sample_id", genes, ALIKE, Scratch(spark, "p1"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The samples of every cluster of alike expression profiles."""
    return _p1(spark, folder)[2].withColumnRenamed("key", "sample_id")


def p1_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Size, typical samples and tissues of every cluster."""
    df, genes, members = _p1(spark, folder)
    members = Scratch(spark, "p1m").save(members)
    tissue = table(spark, folder, METADATA).groupBy(F.col("sample_id").alias("key")).agg(F.max("tissue").alias("tissue"))
    per = members.join(tissue, "key", "left").groupBy("cluster_id", "tissue").agg(F.count("*").alias("n"))
    named = per.groupBy("cluster_id").agg(
        F.count("tissue").alias("n_tissues"), F.max_by("tissue", F.when(F.col("tissue").isNotNull(), F.struct("n", "tissue"))).alias("main_tissue")
    )
    report = cluster.cluster_report(df, "sample_id", genes, members)
    return report.join(named, "cluster_id").select("cluster_id", "n_members", "cell_members", F.array_join("typical", "; ").alias("typical"), "n_tissues", "main_tissue")


# 3. free entries ------------------------------------------------------------------------------------------
def _p3(spark: SparkSession, folder: str) -> DataFrame:
    return canon.canonical_entries(table(spark, folder, PROTEOMICS), "record_id", FIELDS, table(spark, folder, "canonical_terms"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The term meant by every entry that is no canonical name, -1 for none."""
    return _p3(spark, folder).select(F.col("key").cast("bigint").alias("record_id"), "field_name", "term_id")


def p3_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """The values that stand for no term, with their records."""
    return _p3(spark, folder).where("term_id = -1").groupBy("field_name", "value").agg(F.count("*").alias("n_records"))


# 4. similar sets ------------------------------------------------------------------------------------------
OVERLAP = 0.5


def module_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Each module once with the set of its genes in upper case."""
    one = packed.one_list_per_key(
        table(spark, folder, MODULES).where("module_id IS NOT NULL"), "module_id", ["feature_set", "top_genes"], latest="loaded_at"
    )
    genes = F.transform(packed.packed_items(F.col("top_genes")), F.upper)
    return setpairs.set_classes(one.select(F.col("module_id").alias("key"), F.col("feature_set").alias("grp"), genes.alias("items")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs of modules of one feature set whose genes overlap by half or more."""
    scratch = Scratch(spark, "p4")
    classes = scratch.save(module_sets(spark, folder))
    pairs = setpairs.expand_pairs(classes, setpairs.similar_classes(classes, OVERLAP, scratch))
    return pairs.select(F.col("a").cast("bigint").alias("module_id_a"), F.col("b").cast("bigint").alias("module_id_b"))


def p4_class_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The degree of overlap of every pair of different gene sets of a feature set."""
    scratch = Scratch(spark, "p4")
    classes = scratch.save(module_sets(spark, folder))
    pairs = setpairs.similar_classes(classes, OVERLAP, scratch)
    return pairs.select("grp", F.least("cls_a", "cls_b").alias("set_a"), F.greatest("cls_a", "cls_b").alias("set_b"), "common", F.round("overlap", 6).alias("overlap"))


def p4_links(spark: SparkSession, folder: str) -> DataFrame:
    """Per module its class and the number of modules it is similar to."""
    scratch = Scratch(spark, "p4")
    classes = scratch.save(module_sets(spark, folder))
    links = setpairs.link_counts(classes, setpairs.similar_classes(classes, OVERLAP, scratch))
    return links.select(F.col("key").alias("module_id"), F.col("grp").alias("feature_set"), F.col("cls").alias("set_id"), "n_links")


# 6. percentiles -------------------------------------------------------------------------------------------
def scored_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Each sample, release and score type once, with the tissue of the sample's metadata."""
    programs = list(SLUGS.values())
    scores = (
        table(spark, folder, SCORES).where("sample_id IS NOT NULL").groupBy("sample_id", "release_id", "score_type")
        .agg(F.max(F.struct(*[F.col(p) for p in programs])).alias("s")).select("sample_id", "release_id", "score_type", "s.*")
    )
    tissue = table(spark, folder, METADATA).where("sample_id IS NOT NULL").groupBy("sample_id").agg(F.max("tissue").alias("tissue"))
    return scores.join(tissue.where("tissue IS NOT NULL"), "sample_id")


def program_percentiles(spark: SparkSession, folder: str, scratch: Scratch) -> DataFrame:
    """Quartiles per release, tissue, score type and program."""
    q = quantiles.percentiles(
        scored_samples(spark, folder), ["release_id", "tissue", "score_type"], {p: s for p, s in SLUGS.items()}, [0.25, 0.5, 0.75], scratch, F.col("sample_id")
    )
    return q.select("release_id", "tissue", "score_type", F.col("measure").alias("ecm_program"), "n", F.col("q0").alias("q25"), F.col("q1").alias("median"), F.col("q2").alias("q75"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The summary rows that contradict the percentiles of the scores by more than 0.05."""
    keys = ["release_id", "tissue", "score_type", "ecm_program"]
    q = program_percentiles(spark, folder, Scratch(spark, "p6"))
    off = lambda a, b: ~F.isnan(a) & (F.abs(F.col(a) - F.col(b)) > 0.05)
    wrong = F.coalesce(off("median_score", "median"), F.lit(False)) | F.coalesce(off("q25_score", "q25"), F.lit(False)) | F.coalesce(off("q75_score", "q75"), F.lit(False))
    return table(spark, folder, SUMMARY).join(q, keys).where(wrong).select(*keys).distinct()


def p6_quartiles(spark: SparkSession, folder: str) -> DataFrame:
    """Quartiles of every release, tissue, score type and program."""
    q = program_percentiles(spark, folder, Scratch(spark, "p6"))
    return q.select("release_id", "tissue", "score_type", "ecm_program", "n", *[F.round(c, 6).alias(c) for c in ("q25", "median", "q75")])


def p6_merged_releases(spark: SparkSession, folder: str) -> DataFrame:
    """Quartiles over all releases from the releases' grid summaries, off by at most 0.005."""
    long = scored_samples(spark, folder).select(
        "release_id", "tissue", "score_type", F.explode(F.array(*[F.struct(F.lit(p).alias("ecm_program"), F.col(s).alias("score")) for p, s in SLUGS.items()])).alias("x")
    ).select("release_id", "tissue", "score_type", "x.*")
    keys = ["tissue", "score_type", "ecm_program"]
    # what is kept of a release is its summary: later releases are written beside it and merged without the scores
    summaries = Scratch(spark, "p6m").save(quantiles.grid_summary(long, ["release_id", *keys], "score"))
    merged = quantiles.merge_summaries(summaries, keys)
    out = quantiles.summary_percentiles(merged, keys, [0.25, 0.5, 0.75])
    return out.select(*keys, "n", *[F.round(f"q{i}", 3).alias(c) for i, c in enumerate(("q25", "median", "q75"))])


# 7. containers --------------------------------------------------------------------------------------------
def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every document, or of every piece of one that exceeds a container."""
    return packing.pack(table(spark, folder, "documents"), "doc_id", "text", Scratch(spark, "p7")).withColumnRenamed("key", "doc_id")


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers are."""
    per = p7_containers(spark, folder).where("container IS NOT NULL").groupBy("container").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("pieces"))
    return per.agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"), (F.sum("tokens") / F.count("*") / packing.CAPACITY).alias("filled"))


def p7_conservation(spark: SparkSession, folder: str) -> DataFrame:
    """What packing must keep: every document once, no token lost between its pieces, nothing cut that fits, nothing too full."""
    rows = Scratch(spark, "p7c").save(p7_containers(spark, folder))
    docs = rows.groupBy("doc_id").agg(
        F.count("*").alias("pieces"), F.sum("n_tokens").alias("tokens"), F.max(F.col("token_start") + F.col("n_tokens")).alias("end"), F.count("container").alias("placed"),
    )
    full = rows.where("container IS NOT NULL").groupBy("container").agg(F.sum("n_tokens").alias("tokens"))
    return docs.agg(
        F.count("*").alias("documents"), F.count_if(F.expr("tokens = 0 AND placed = 0")).alias("empty"), F.count_if(F.expr("end <> tokens OR (tokens > 0 AND placed <> pieces)")).alias("with_gaps"),
        F.count_if(F.col("pieces") > F.greatest(F.ceil(F.col("tokens") / packing.CAPACITY), F.lit(1))).alias("cut_though_fitting"),
    ).crossJoin(full.agg(F.count_if(F.col("tokens") > packing.CAPACITY).alias("too_full")))  # one row beside one row


# 8. leaks -------------------------------------------------------------------------------------------------
def _p8(spark: SparkSession, folder: str) -> DataFrame:
    return leak.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """The documents and the items whose passages they have."""
    return _p8(spark, folder).select(F.col("doc").cast("bigint").alias("doc_id"), F.col("item").cast("bigint").alias("item_id"))


def p8_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """How much of each item leaks into each document, and whether in another order."""
    return _p8(spark, folder).withColumnsRenamed({"doc": "doc_id", "item": "item_id"}).withColumn("coverage", F.round("coverage", 6))


def p8_leaked_items(spark: SparkSession, folder: str) -> DataFrame:
    """Per item the documents it leaks into and the greatest coverage."""
    return _p8(spark, folder).groupBy(F.col("item").alias("item_id")).agg(F.count("*").alias("n_documents"), F.round(F.max("coverage"), 6).alias("coverage"))


# 9. look-alikes -------------------------------------------------------------------------------------------
def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of documents that read the same though their strings differ."""
    classes = lookalike.look_alike_classes(table(spark, folder, "documents"), "doc_id", "text", Scratch(spark, "p9"))
    return lookalike.look_alike_pairs(classes).select(F.col("a").cast("bigint").alias("doc_id_a"), F.col("b").cast("bigint").alias("doc_id_b"))


def p9_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Each document of a class of look-alikes, with the class and the number of its look-alikes."""
    links = lookalike.look_alike_links(lookalike.look_alike_classes(table(spark, folder, "documents"), "doc_id", "text", Scratch(spark, "p9")))
    return links.withColumnsRenamed({"key": "doc_id", "class_key": "class_id"})


def p9_spellings(spark: SparkSession, folder: str) -> DataFrame:
    """The spelling of every word with suspect characters, where one letter more, less or other than in the corpus is allowed."""
    scan = lookalike.scanned(table(spark, folder, "documents"), "doc_id", "text", Scratch(spark, "p9"))
    return lookalike.canonical_spellings(scan.where("word IS NOT NULL").select("word", "n", "suspect"), max_cost=1)


def p9_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """The canonical form of every text that is written in another way."""
    done = lookalike.canonical_texts(table(spark, folder, "documents"), "doc_id", "text", Scratch(spark, "p9"))
    return done.where("text <> canonical").select(F.col("key").alias("doc_id"), "canonical")


def queries() -> dict:
    return {
        f.__name__: f
        for f in (p1_found, p1_clusters, p4_found, p4_class_pairs, p4_links, p3_found, p3_unmatched, p6_found, p6_quartiles, p6_merged_releases, p7_containers, p7_fill, p7_conservation, p8_found, p8_tiles, p8_leaked_items, p9_found, p9_classes, p9_spellings, p9_canonical)
    }


_SAMPLES = f"""samples AS (
  SELECT DISTINCT s.sample_id, s.release_id, s.score_type, m.tissue, {', '.join('s.' + c for c in SLUGS.values())}
  FROM {SCORES} s JOIN (SELECT sample_id, max(tissue) AS tissue FROM {METADATA} GROUP BY 1) m ON s.sample_id = m.sample_id
  WHERE m.tissue IS NOT NULL), long AS (
  {' UNION ALL '.join(f"SELECT release_id, tissue, score_type, '{p}' AS ecm_program, {c} AS v FROM samples WHERE {c} IS NOT NULL AND NOT isnan({c})" for p, c in SLUGS.items())})"""
_QUARTILES = f"""WITH {_SAMPLES} SELECT release_id, tissue, score_type, ecm_program, count(*) AS n,
  quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q75 FROM long GROUP BY 1, 2, 3, 4"""


def _reading_sql(c: str) -> str:
    """The reading of a text by table, for the characters of the European blocks and the full-width forms."""
    blocks = [*range(0xA0, 0x530), *range(0x1F00, 0x2070), 0x3000, *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)]
    to = {chr(x): unicodedata.normalize("NFC", lookalike.fold_text(chr(x))) for x in blocks if not unicodedata.combining(chr(x))}
    changed = {k: v for k, v in to.items() if v != k}
    one = {k: v for k, v in changed.items() if len(v) == 1}
    quote = lambda x: x.replace("'", "''")
    out = f"translate(replace(replace({c}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '{quote(''.join(one))}', '{quote(''.join(one.values()))}')"
    for k, v in changed.items():
        if len(v) != 1:
            out = f"replace({out}, '{k}', '{quote(v)}')"
    return f"nfc_normalize(replace(replace({out}, chr(65279), ''), chr(9), ' '))"


def oracle_sql() -> dict[str, str]:
    read = _reading_sql("text")
    grams = lambda key, col, src: f"""SELECT DISTINCT {key}, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS gram
        FROM (SELECT {key}, regexp_extract_all(lower({_reading_sql(col)}), '[\\p{{L}}\\p{{N}}]+') AS w FROM {src})"""  # noqa: E731
    modules = f"SELECT module_id, feature_set, top_genes, row_number() OVER (PARTITION BY module_id ORDER BY loaded_at DESC NULLS LAST) AS rn FROM {MODULES}"
    sets = f"""sets AS (SELECT row_key AS module_id, feature_set, list_sort(list(DISTINCT upper(item))) AS items FROM ({numbered.oracle_sql()['p2_found']})
        JOIN ({modules}) m ON m.module_id = row_key AND rn = 1 AND feature_set IS NOT NULL WHERE field_name = 'top_genes' GROUP BY 1, 2)"""
    pairs = """pairs AS (SELECT a.module_id AS a, b.module_id AS b, len(list_intersect(a.items, b.items)) AS c, len(a.items) AS na, len(b.items) AS nb
        FROM sets a JOIN sets b ON a.feature_set = b.feature_set AND a.module_id < b.module_id)"""
    return {
        "p7_conservation": "SELECT count(*) AS documents, count_if(coalesce(text, '') = '') AS empty, CAST(0 AS BIGINT) AS with_gaps, CAST(0 AS BIGINT) AS cut_though_fitting, CAST(0 AS BIGINT) AS too_full FROM documents",
        "p8_found": f"""WITH d AS ({grams('doc_id', 'text', 'documents')}), i AS ({grams('item_id', 'item_text', 'eval_items')}) SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (gram)""",
        "p9_found": f"""WITH c AS (SELECT doc_id, md5(text) AS w, md5({read}) AS r FROM documents WHERE text IS NOT NULL)
            SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM c a JOIN c b ON a.r = b.r AND a.w <> b.w AND a.doc_id < b.doc_id""",
        "p4_class_pairs": f"""WITH {sets}, cls AS (SELECT feature_set AS grp, md5(array_to_string(list_transform(items, lambda x: len(x) || ':' || x), '')) AS cls, any_value(items) AS items FROM sets GROUP BY 1, 2),
            p AS (SELECT a.grp, a.cls AS set_a, b.cls AS set_b, len(list_intersect(a.items, b.items)) AS common, len(a.items) AS na, len(b.items) AS nb FROM cls a JOIN cls b ON a.grp = b.grp AND a.cls < b.cls)
            SELECT grp, set_a, set_b, CAST(common AS INTEGER) AS common, round(common / (na + nb - common), 6) AS overlap FROM p WHERE 3 * common >= na + nb""",
        "p4_links": f"""WITH {sets}, {pairs}, l AS (SELECT a AS m FROM pairs WHERE 3 * c >= na + nb UNION ALL SELECT b FROM pairs WHERE 3 * c >= na + nb), n AS (SELECT m, count(*) AS k FROM l GROUP BY 1)
            SELECT module_id, feature_set, md5(array_to_string(list_transform(items, lambda x: len(x) || ':' || x), '')) AS set_id, coalesce(k, 0) AS n_links FROM sets LEFT JOIN n ON m = module_id""",
        "p1_found": f"""WITH RECURSIVE rows AS (SELECT DISTINCT * FROM {EXPRESSION} WHERE sample_id IS NOT NULL),
            x AS (SELECT sample_id, gene, v FROM (UNPIVOT rows ON COLUMNS(* EXCLUDE (sample_id)) INTO NAME gene VALUE v) WHERE NOT isnan(v)),
            alike AS (SELECT a.sample_id AS a, b.sample_id AS b FROM x a JOIN x b ON a.gene = b.gene AND a.sample_id < b.sample_id GROUP BY 1, 2 HAVING count(*) >= 3 AND corr(a.v, b.v) >= {ALIKE}),
            edges AS (SELECT a, b FROM alike UNION SELECT b, a FROM alike), reach AS (SELECT a, a AS b FROM (SELECT DISTINCT a FROM edges) UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a)
            SELECT min(b) AS cluster_id, a AS sample_id FROM reach GROUP BY a""",
        "p8_leaked_items": f"""WITH d AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS gram FROM (SELECT doc_id, regexp_extract_all(lower({read}), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents)),
            w AS (SELECT item_id, regexp_extract_all(lower({_reading_sql('item_text')}), '[\\p{{L}}\\p{{N}}]+') AS w FROM eval_items), i AS (SELECT item_id, unnest(range(1, len(w) - 10)) AS pos, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS gram FROM w),
            m AS (SELECT DISTINCT doc_id, item_id, pos FROM d JOIN i USING (gram)), c AS (SELECT doc_id, item_id, count(DISTINCT p) AS covered FROM (SELECT doc_id, item_id, unnest(range(pos, pos + 12)) AS p FROM m) GROUP BY 1, 2)
            SELECT item_id, count(*) AS n_documents, round(max(covered / len(w)), 6) AS coverage FROM c JOIN w USING (item_id) GROUP BY 1""",
        "p9_classes": f"""WITH c AS (SELECT doc_id, md5(text) AS w, md5({read}) AS r FROM documents WHERE text IS NOT NULL), s AS (SELECT r, w, count(*) AS copies FROM c GROUP BY 1, 2),
            k AS (SELECT c.r, min(doc_id) AS class_id, count(DISTINCT w) AS n_strings, count(*) AS texts FROM c GROUP BY 1 HAVING count(DISTINCT w) > 1)
            SELECT doc_id, class_id, n_strings, CAST(texts - copies AS BIGINT) AS n_links FROM c JOIN k USING (r) JOIN s USING (r, w)""",
        "p4_found": f"WITH {sets}, {pairs} SELECT a AS module_id_a, b AS module_id_b FROM pairs WHERE 3 * c >= na + nb",
        "p6_found": f"""SELECT DISTINCT release_id, tissue, score_type, ecm_program FROM {SUMMARY} JOIN ({_QUARTILES}) USING (release_id, tissue, score_type, ecm_program)
            WHERE abs(median_score - median) > 0.05 OR abs(q25_score - q25) > 0.05 OR abs(q75_score - q75) > 0.05""",
        "p6_quartiles": f"SELECT release_id, tissue, score_type, ecm_program, n, round(q25, 6) AS q25, round(median, 6) AS median, round(q75, 6) AS q75 FROM ({_QUARTILES})",
        "p6_merged_releases": f"""WITH {_SAMPLES} SELECT tissue, score_type, ecm_program, n,
            {', '.join(f'round((floor(vs[CAST(floor((n - 1) * {q}) AS BIGINT) + 1] / CAST(0.01 AS DOUBLE)) + 0.5) * CAST(0.01 AS DOUBLE), 3) AS {c}' for q, c in ((0.25, 'q25'), (0.5, 'median'), (0.75, 'q75')))}
            FROM (SELECT tissue, score_type, ecm_program, count(*) AS n, list_sort(list(v)) AS vs FROM long GROUP BY 1, 2, 3)""",
    }

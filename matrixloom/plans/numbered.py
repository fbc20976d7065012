"""Queries of the numbered problems that belong to the core: packed fields (2) and wide tables (5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matrixloom.operators import packed, wide
from matrixloom.plans.tables import MODULES, PROGRAMS, PROTEOMICS, table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """One row per item of top_genes, program_genes and reference_modules, with its position."""
    modules = packed.one_list_per_key(table(spark, folder, MODULES), "module_id", ["top_genes"], latest="loaded_at")
    programs = packed.one_list_per_key(table(spark, folder, PROGRAMS), "program_id", ["program_genes", "reference_modules"])
    # the texts are few megabytes but costly to split, so they are spread over as many tasks as there are
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    modules, programs = modules.repartition(tasks, F.xxhash64("module_id")), programs.repartition(tasks, F.xxhash64("program_id"))
    out = None
    for df, name, key, column in ((modules, MODULES, "module_id", "top_genes"), (programs, PROGRAMS, "program_id", "program_genes"), (programs, PROGRAMS, "program_id", "reference_modules")):
        part = packed.explode_packed(df, [key], column).select(
            F.lit(name).alias("table_name"), F.col(key).cast("bigint").alias("row_key"), F.lit(column).alias("field_name"), "item_pos", "item"
        )
        out = part if out is None else out.unionByName(part)
    return out


def p2_item_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many lists and list places each item of each field has."""
    return p2_found(spark, folder).groupBy("table_name", "field_name", "item").agg(
        F.count_distinct("row_key").alias("n_lists"), F.count("*").alias("n_places"), F.min("item_pos").alias("best_pos")
    )


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The filled cells of the wide table of runs and gene symbols."""
    df = table(spark, folder, PROTEOMICS)
    columns = wide.attribute_dictionary(df.select(wide.clean_symbol(F.col("gene_symbol")).alias("attribute")))
    cells = wide.wide_filled_cells(wide.run_cells(df), columns)
    return cells.select(F.col("entity").cast("bigint").alias("run_id"), F.col("attribute").alias("gene_symbol"))


def p5_wide(spark: SparkSession, folder: str) -> DataFrame:
    """One row per run with its tissue and a DOUBLE column per gene symbol."""
    df = table(spark, folder, PROTEOMICS)
    columns = wide.attribute_dictionary(df.select(wide.clean_symbol(F.col("gene_symbol")).alias("attribute")))
    out = wide.eav_to_wide(wide.run_cells(df), columns, entity="run_id")
    return out.join(wide.most_common(df, "run_id", "tissue", "run_tissue"), "run_id", "left")


def queries() -> dict:
    return {"p2_found": p2_found, "p2_item_counts": p2_item_counts, "p5_found": p5_found, "p5_wide": p5_wide}


_B = r"[\s\x{00a0}\x{2000}-\x{200b}\x{202f}\x{3000}\x{feff}]"
_D = r"[,;|\t\n\r，；]"
_H = r"[ \x{00a0}\x{2000}-\x{200b}\x{202f}\x{3000}\x{feff}]*"
# every match is one place of the list: a quoted span and its delimiter, or text up to the next delimiter
_PLACE = rf"""{_H}(?:"(?:[^"]|"")*"|''(?:[^'']|'''')*''){_H}(?:{_D}|$)|[^,;|\t\n\r，；]*(?:{_D}|$)"""


def _items_sql(view: str, key: str, column: str) -> str:
    order = "loaded_at DESC NULLS LAST, " if key == "module_id" else ""
    other = "" if key == "module_id" else "program_genes DESC NULLS LAST, reference_modules DESC NULLS LAST"
    return f"""
    SELECT '{view}' AS table_name, {key} AS row_key, '{column}' AS field_name, place, item FROM (
      SELECT {key}, place, regexp_replace(CASE
          WHEN regexp_full_match(t, '(?s)".*"') AND length(t) >= 2 THEN replace(t[2:-2], '""', '"')
          WHEN regexp_full_match(t, '(?s)''.*''') AND length(t) >= 2 THEN replace(t[2:-2], '''''', '''')
          ELSE t END, '^{_B}+|{_B}+$', '', 'g') AS item
      FROM (SELECT {key}, place, regexp_replace(regexp_replace(raw, '{_D}$', ''), '^{_B}+|{_B}+$', '', 'g') AS t
        FROM (SELECT {key}, unnest(places) AS raw, generate_subscripts(places, 1) AS place
          FROM (SELECT {key}, regexp_extract_all(CASE WHEN body LIKE '[%]' THEN body[2:-2] ELSE body END, '{_PLACE}') AS places
            FROM (SELECT {key}, regexp_replace(coalesce({column}, ''), '^{_B}+|{_B}+$', '', 'g') AS body
              FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}{other or column + ' DESC NULLS LAST'}) AS rn FROM {view})
              WHERE rn = 1 AND {key} IS NOT NULL)))))
    WHERE item <> ''"""


_P2 = (
    "SELECT table_name, row_key, field_name, CAST(row_number() OVER (PARTITION BY table_name, row_key, field_name ORDER BY place) AS INTEGER) AS item_pos, item FROM ("
    + " UNION ALL ".join(_items_sql(v, k, c) for v, k, c in ((MODULES, "module_id", "top_genes"), (PROGRAMS, "program_id", "program_genes"), (PROGRAMS, "program_id", "reference_modules")))
    + ")"
)


def oracle_sql() -> dict[str, str]:
    sym = r"upper(regexp_replace(gene_symbol, '^[\s\x{00a0}\x{2000}-\x{200b}\x{202f}\x{3000}\x{feff}]+|[\s\x{00a0}\x{2000}-\x{200b}\x{202f}\x{3000}\x{feff}]+$', '', 'g'))"
    return {
        "p2_found": _P2,
        "p2_item_counts": f"SELECT table_name, field_name, item, count(DISTINCT row_key) AS n_lists, count(*) AS n_places, min(item_pos) AS best_pos FROM ({_P2}) GROUP BY 1, 2, 3",
        "p5_found": f"""SELECT DISTINCT run_id, {sym} AS gene_symbol FROM {PROTEOMICS}
            WHERE run_id IS NOT NULL AND log1p_nsaf IS NOT NULL AND NOT isnan(log1p_nsaf) AND {sym} NOT IN ('', 'NAN', 'NONE')""",
    }

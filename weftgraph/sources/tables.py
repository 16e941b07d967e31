"""Fact tables: schemas, keyed writes, referential guards and written intermediate tables."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGE = "start_byte int, end_byte int, start_line int, start_column int, end_line int, end_column int"

#: Fact tables by name; a position is one struct, JSON payloads are nested types.
SCHEMAS = {
    "files": "file_id string, path string, language string, content_hash string, status string, index_time timestamp",
    "symbols": f"symbol_id string, file_id string, kind string, name string, qualified_name string, symbol_path array<string>, language string, range struct<{RANGE}>, name_range struct<{RANGE}>, signature string, visibility string, exported boolean, static boolean, async boolean, container_id string, scope_id string, layer string",
    "scopes": f"scope_id string, file_id string, kind string, name string, scope_path string, range struct<{RANGE}>, parent_id string",
    "references": f"reference_id string, file_id string, source_symbol string, scope_id string, kind string, text string, name string, receiver string, arity int, range struct<{RANGE}>, resolved_symbol_id string, resolved_confidence double, resolved_strategy string, resolved_provenance string, binding_id string",
    "imports": f"import_id string, file_id string, kind string, module string, imported_name string, local_name string, is_wildcard boolean, is_relative boolean, range struct<{RANGE}>, alias string",
    "symbol_edges": f"edge_id string, source string, target string, kind string, confidence double, provenance string, ref_id string, location struct<{RANGE}>, resolved_by string",
    "callsites": f"callsite_id string, reference_id string, caller string, receiver string, args array<struct<value:string,data_node_id:string,start_byte:int>>, range struct<{RANGE}>",
    "bindings": f"binding_id string, file_id string, function_id string, scope_id string, kind string, name string, symbol_id string, visible_from_byte int, range struct<{RANGE}>",
    "binding_uses": f"use_id string, file_id string, scope_id string, binding_id string, reference_id string, name string, range struct<{RANGE}>",
    "data_nodes": f"data_node_id string, file_id string, function_id string, kind string, binding_id string, callsite_id string, name string, access_path string, arg_index int, range struct<{RANGE}>",
    "dataflow_edges": "edge_id string, source string, target string, kind string, confidence double",
    "cfg_nodes": f"cfg_node_id string, function_id string, kind string, range struct<{RANGE}>, effects array<struct<tag:string,place:string,callee:string,source:string>>, managed_scope_start_byte int",
    "cfg_edges": "edge_id string, function_id string, source_node string, target_node string, kind string",
    "extraction_state": "file_id string, unit_id string, layer string, content_hash string, status string, node_count long, edge_count long, capability_mask int, resolution_fingerprint string",
    "domain_rules": "rule_id string, language string, rule_kind string, pattern string, pattern_kind string, source string, status string, confidence double",
    "function_pointer_annotations": "source_symbol string, field_name string, target_symbol string",
    "reference_resolutions": "id long, reference_id string, closure_id string, generation long, target_symbol_id string, strategy string, confidence double, semantic_confidence string, is_visible boolean",
    "file_inventory": "path string, size long, modified timestamp, language string, fingerprint string",
    "symbol_hints": "name string, file_id string",
    "diagnostics": "path string, error string",
}


def schema(name: str) -> T.StructType:
    return T._parse_datatype_string(SCHEMAS[name])


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder of a local session, an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weftgraph-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


#: Intermediate tables that this driver has written.
_WRITTEN: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used yet."""
    _WRITTEN.append(f"{shared_dir(spark)}/weftgraph/{name}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` below the shared folder and read it back, so loops keep short plans and survive lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_intermediate(spark: SparkSession) -> int:
    """Delete the intermediate tables of this driver, once the results that read them are stored; returns how many there were."""
    n = len(_WRITTEN)
    while _WRITTEN:
        _file_system(spark, path := _WRITTEN.pop()).delete(_hadoop_path(spark, path), True)
    return n


def _hadoop_path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    return _hadoop_path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish(spark: SparkSession, folder: str, name: str, content: str) -> bool:
    """Make a small file ``name`` visible in ``folder``, whole or not at all; False if there is one of that name.

    The file is written elsewhere and renamed, which fails onto an existing file.
    """
    jvm, fs, hadoop = spark.sparkContext._jvm, _file_system(spark, folder), spark.sparkContext._jsc.hadoopConfiguration()
    target = fs.makeQualified(_hadoop_path(spark, f"{folder}/{name}"))
    temporary = fs.makeQualified(_hadoop_path(spark, f"{folder}.temporary/{uuid.uuid4().hex}"))
    out = fs.create(temporary, True)
    out.write(bytearray(content.encode()))
    out.close()
    fs.mkdirs(target.getParent())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), hadoop).rename(temporary, target, options)
    except Exception:
        fs.delete(temporary, False)
        if not fs.exists(target):
            raise
        return False
    return True


def published(spark: SparkSession, folder: str) -> list[str]:
    """Names of the visible files of ``folder``, in order."""
    fs, where = _file_system(spark, folder), _hadoop_path(spark, folder)
    return sorted(n for s in fs.listStatus(where) if not (n := s.getPath().getName()).startswith(".")) if fs.exists(where) else []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    _file_system(spark, path).delete(_hadoop_path(spark, path), True)


def enforce(df: DataFrame, name: str) -> DataFrame:
    """``df`` in the column order and types of fact table ``name``; missing columns become null."""
    have = set(df.columns)
    return df.select([(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name)])


def fact_id(*parts: Column | str) -> Column:
    """Stable id of NUL-joined parts, as 64 hex digits; null parts count as empty."""
    return F.sha2(F.concat_ws("\x00", *[F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")) for p in parts]), 256)


def short_id(column: Column) -> Column:
    return F.substring(column, 1, 8)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keyed upsert: rows of ``new`` (one per key, the last in order of all columns) replace those of ``old``."""
    one = new.groupBy(*keys).agg(F.max(F.struct(*[c for c in new.columns if c not in keys])).alias("v")).select(*keys, "v.*") if len(new.columns) > len(keys) else new.distinct()
    return old.join(one.select(*keys), keys, "left_anti").unionByName(one.select(*old.columns))


def replace_by(old: DataFrame, new: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """All facts of the changed keys (files, layers, functions) give way to ``new``."""
    return old.join(changed.select(key).distinct(), key, "left_anti").unionByName(new.select(*old.columns))


def guard_drop(rows: DataFrame, column: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Drop rows whose parent is absent; a null parent is absent."""
    return rows.join(parents.select(F.col(parent_key).alias(column)).distinct(), column, "left_semi").select(*rows.columns)


def guard_null(rows: DataFrame, column: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Set a parent id that is absent to null."""
    known = parents.select(F.col(parent_key).alias("__parent")).distinct()
    joined = rows.join(known, F.col(column) == F.col("__parent"), "left")
    return joined.select(*[F.col("__parent").alias(c) if c == column else F.col(c) for c in rows.columns])


class Catalog:
    """Fact tables below one folder, each version immutable, with a pointer to the visible one."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def generations(self, name: str) -> list[int]:
        return [int(g) for g in published(self.spark, f"{self.folder}/visible/{name}")]

    def _place(self, name: str, generation: int) -> str:
        return self.spark.read.text(f"{self.folder}/visible/{name}/{generation:09d}", wholetext=True).first()[0]

    def read(self, name: str, generation: int | None = None) -> DataFrame:
        """The newest visible generation, or the one named; an empty table before the first."""
        known = self.generations(name)
        if generation is None and not known:
            return self.spark.createDataFrame([], schema(name))
        return self.spark.read.schema(schema(name)).parquet(self._place(name, generation or known[-1]))

    def write(self, name: str, df: DataFrame) -> int:
        """Stage a new generation under a name of its own, then publish its pointer; returns the generation.

        Of writers at the same time each gets a generation; none overwrites another's.
        """
        place = f"{self.folder}/{name}/{uuid.uuid4().hex}"
        enforce(df, name).write.parquet(place)
        generation = (self.generations(name) or [0])[-1] + 1
        while not publish(self.spark, f"{self.folder}/visible/{name}", f"{generation:09d}", place):
            generation += 1
        return generation

    def keep(self, name: str, newest: int) -> None:
        """Prune all but the ``newest`` visible generations."""
        for g in self.generations(name)[:-newest]:
            place = self._place(name, g)
            remove(self.spark, f"{self.folder}/visible/{name}/{g:09d}")
            remove(self.spark, place)

    def set_metadata(self, key: str, value: str) -> None:
        """Key-value sink: the newest value of a key is the visible one."""
        folder = f"{self.folder}/metadata/{short_name(key)}"
        n = len(published(self.spark, folder))
        while not publish(self.spark, folder, f"{n:09d}", value):
            n += 1

    def metadata(self, key: str) -> str | None:
        folder = f"{self.folder}/metadata/{short_name(key)}"
        names = published(self.spark, folder)
        return self.spark.read.text(f"{folder}/{names[-1]}", wholetext=True).first()[0] if names else None


def short_name(key: str) -> str:
    """A file name that only this key has."""
    return hashlib.sha256(key.encode()).hexdigest()

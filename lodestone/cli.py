"""Commands over stored collections: python -m lodestone.cli COMMAND PATH ... (PATH: a Parquet collection)."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.embedders import HashEmbedder
from .operators import documents
from .operators.collection import SCHEMA, Collection, from_rows
from .operators.filters import compile_filter, variant_resolver
from .plans import dsl
from .sources import binary, crypto, formats
from .types import CollectionConfig, FormatError, LodestoneError

CONFIG = ".lodestone.json"
COMMANDS = ("init", "add", "add-many", "import", "get", "delete", "search", "query", "find", "count", "distinct", "stats", "embed", "export", "inspect", "migrate", "config", "run", "repl", "flush", "completions")


def stored(path: str) -> dict:
    if not os.path.exists(path):
        return {}
    with open(path) as f:
        return json.load(f)


def settings(flags: dict) -> dict:
    """Flag, then environment (LODESTONE_DIMENSIONS and so on), then the project's file, then the user's, then defaults."""
    names = ("dimensions", "quantization", "metric", "key")
    env = {n: coerce(os.environ[f"LODESTONE_{n.upper()}"]) for n in names if f"LODESTONE_{n.upper()}" in os.environ}
    known = {"dimensions": 64, "quantization": "F32", "metric": "cosine"} | stored(os.path.expanduser(f"~/{CONFIG}")) | stored(CONFIG) | env
    return known | {k: v for k, v in flags.items() if v is not None}


def coerce(text: str):
    """Digits become a number, true and false a boolean."""
    return int(text) if text.isdigit() else {"true": True, "false": False}.get(text, text)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone")
    sub = p.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        c = sub.add_parser(name)
        c.add_argument("path", **({"nargs": "?"} if name in ("config", "completions") else {}))
        c.add_argument("args", nargs="*")
        c.add_argument("--filter")
        c.add_argument("--sort")
        c.add_argument("--format", default="json")
        for n in ("--limit", "--skip", "--top-k", "--dimensions"):
            c.add_argument(n, type=int)
        for n in ("--quantization", "--metric", "--key", "--new-key"):
            c.add_argument(n)
        c.add_argument("--force", action="store_true")
        c.add_argument("--embedding", action="store_true")
    return p


def show(df, kind: str) -> None:
    """One page of results on the terminal; larger outputs go through export."""
    if kind == "table":
        print(formats.as_table(df))
        return
    rows = [json.loads(r.j) for r in df.select(F.to_json(F.struct("*")).alias("j")).collect()]
    print(json.dumps(rows[0] if len(rows) == 1 else rows, indent=2) if kind == "json" else "\n".join(map(json.dumps, rows)))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lodestone").getOrCreate()
    s = settings({"dimensions": a.dimensions, "quantization": a.quantization, "metric": a.metric})
    try:
        config = CollectionConfig(s["dimensions"], s["quantization"], s["metric"])
        where = compile_filter(a.filter, variant_resolver()) if a.filter else None
        key = lambda text: crypto.KeySource(key=bytes.fromhex(text)) if text else None
        if a.command == "config":
            given = {k: coerce(v) for k, _, v in (x.partition("=") for x in [a.path, *a.args] if x)}
            if given:
                both = stored(CONFIG) | given
                with open(CONFIG, "w") as f:
                    json.dump(both, f)
            print(json.dumps({k: "****" if "key" in k.lower() else v for k, v in settings({}).items()}))
            return 0
        if a.command == "completions":
            print(f'complete -W "{" ".join(COMMANDS)}" lodestone')
            return 0
        if a.command == "embed":
            print(json.dumps(HashEmbedder(config.dimensions).embed_many([" ".join([a.path, *a.args])])[0]))
            return 0
        if a.command == "inspect":
            blob = formats.read_bytes(spark, a.path)
            if blob is None:
                raise FormatError(f"{a.path} doesn't exist")
            if crypto.is_encrypted(blob) and not a.key:
                raise FormatError(f"{a.path} is encrypted, give --key")
            blob = crypto.decrypt(spark, blob, key(a.key)) if a.key else blob
            print(json.dumps(binary.snapshot_header(binary._plain(blob))))
            return 0
        if a.command == "migrate":
            print(formats.migrate(spark, a.path, a.args[0], key(a.key), key(a.new_key), a.force))
            return 0
        if a.command == "init":
            spark.createDataFrame([], SCHEMA).write.mode("overwrite" if a.force else "error").parquet(a.path)
            return 0
        _recover(spark, a.path)
        c = Collection(spark.read.parquet(a.path), config)
        if a.command in ("add", "add-many", "import"):
            rows = formats.read_entries(spark, a.args[0], "json" if a.format == "json" and a.command == "import" else "jsonl")
            embedder = HashEmbedder(config.dimensions)
            if not rows.where(F.col("text").isNotNull()).isEmpty():
                rows = rows.withColumn("embedding", embedder.column("text"))
            _replace(spark, c.add_many(from_rows(rows, "id", context="context")).df, a.path)
        elif a.command == "delete":
            ids = [dsl.named_id(x) for x in a.args]
            _replace(spark, c.delete(spark.createDataFrame([(int(isinstance(x, int)), str(x)) for x in ids], "id_type int, id string")).df, a.path)
        elif a.command == "flush":
            print("Every command commits what it changes; nothing is pending.")
        elif a.command == "repl":
            return repl(spark, a.path, config, a.format)
        elif a.command == "get":
            show(c.get(dsl.named_id(a.args[0])), a.format)
        elif a.command == "search":
            show(c.query_by_text(a.args[0], HashEmbedder(config.dimensions), a.top_k if a.top_k is not None else 10, where), a.format)
        elif a.command == "query":
            try:
                vector = [float(x) for x in a.args[0].split(",")]
            except ValueError:
                raise FormatError("a vector is numbers with commas between them") from None
            show(c.query(vector, a.top_k if a.top_k is not None else 10, where), a.format)
        elif a.command == "find":
            found, note = documents.page(c.df, where, json.loads(a.sort) if a.sort else None, a.skip or 0, 50 if a.limit is None else a.limit)
            found = found.select("id", *(["embedding"] if a.embedding else []), "context")
            show(formats.flat(found, formats.context_keys(found)) if a.format == "table" else found, a.format)
            if note and a.format == "table":
                print(f"{note}. Use --skip and --limit to see others.", file=sys.stderr)
        elif a.command == "count":
            show(documents.count(c.df, where), a.format)
        elif a.command == "distinct":
            show(documents.distinct(c.df, a.args[0], "cli"), a.format)
        elif a.command == "stats":
            show(c.stats(), a.format)
        elif a.command == "export":
            formats.export(c.df if where is None else c.df.where(where), a.args[0], a.format, a.embedding)
        else:
            show(dsl.run(c, a.args[0], "viewer", HashEmbedder(config.dimensions)), a.format)
        return 0
    except LodestoneError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def repl(spark: SparkSession, path: str, config: CollectionConfig, kind: str) -> int:
    """One query a line until the input ends or a line says exit; an error ends only its line."""
    for line in sys.stdin:
        if (text := line.strip().rstrip(";")) in ("", "exit", "quit"):
            if text:
                break
            continue
        try:
            found = dsl.run(Collection(spark.read.parquet(path), config), text, "viewer", HashEmbedder(config.dimensions))
            if isinstance(found, Collection):
                _replace(spark, found.df, path)
                print("ok")
            else:
                show(found.drop("embedding"), kind)
        except LodestoneError as e:
            print(f"error: {e}", file=sys.stderr)
    return 0


def _paths(spark: SparkSession, path: str):
    jvm = spark._jvm.org.apache.hadoop.fs
    here, new, old = (jvm.Path(path.rstrip("/") + x) for x in ("", ".next", ".last"))
    return here.getFileSystem(spark._jsc.hadoopConfiguration()), here, new, old


def _replace(spark: SparkSession, df, path: str) -> None:
    """A new version beside the old one, which is set aside, not deleted, until the new one has its name."""
    df.write.mode("overwrite").parquet(path.rstrip("/") + ".next")
    fs, here, new, old = _paths(spark, path)
    fs.delete(old, True)
    fs.rename(here, old)
    fs.rename(new, here)
    fs.delete(old, True)


def _recover(spark: SparkSession, path: str) -> None:
    """Takes back the old version where a swap was cut between its renames."""
    fs, here, _, old = _paths(spark, path)
    if not fs.exists(here) and fs.exists(old):
        fs.rename(old, here)


if __name__ == "__main__":
    sys.exit(main())

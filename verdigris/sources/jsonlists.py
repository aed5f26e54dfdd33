"""One JSON array in each file: lists written item by item, and lists of mixed items read with their types."""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter

from verdigris.sources.aside import AsideWriter
from verdigris.sources.readers import whole_texts


# -- writing ---------------------------------------------------------------

class JsonListSource(DataSource):
    """Writes rows (file, pos, item as JSON text), sorted by file and pos and each file's in one partition, as a pretty-printed array a file."""

    @classmethod
    def name(cls) -> str:
        return "jsonlists"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return JsonListWriter(dict(self.options), overwrite)


class JsonListWriter(AsideWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        super().__init__(options["path"], overwrite)
        self.indent, self.ascii = int(options.get("indent", "2")), options.get("ascii") == "true"

    def write_files(self, rows: Iterator[tuple], create: Callable[[str], io.IOBase]) -> int:
        n, name, out = 0, None, None
        for file, pos, item in rows:
            if file != name:
                _ended(out, n)
                name, out, n = file, create(f"{file}.json"), 0
            if pos is not None:
                text = json.dumps(json.loads(item), indent=self.indent, ensure_ascii=self.ascii)
                out.write((("[" if n == 0 else ",") + f"\n{text}".replace("\n", "\n" + " " * self.indent)).encode())
                n += 1
        _ended(out, n)
        return n

    def placed(self, files: list[tuple[str, int]]) -> list[tuple[str, str]]:
        return [(name, name.split("/", 1)[1]) for name, _ in files]


def _ended(out: io.IOBase | None, n: int) -> None:
    if out is not None:
        out.write(b"\n]" if n else b"[]")
        out.close()


def write_json_lists(items: DataFrame, file: Column, order: str, item: str, path: str, indent: int = 2, ascii: bool = False, as_json: bool = False) -> None:
    """In place of what was at path, {path}/{file}.json for each value of `file` (which may name folders): the array of its items in order, pretty-printed.

    Texts become JSON texts, with as_json they are JSON already; other types are
    turned into it. A row without a place in the order is no item, so a file of
    which it is the only row holds an empty array. Rows are dealt by ranges of
    files and sorted, and a task writes one file at a time item by item: no list
    is ever held, however long.
    """
    kind = items.schema[item].dataType
    value = F.col(f"`{item}`")
    text = value if as_json else F.to_json(value) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType, T.VariantType)) else F.regexp_replace(F.to_json(F.array(value)), "^\\[|\\]$", "")
    rows = items.select(file.alias("file"), F.col(order).alias("pos"), F.coalesce(text, F.lit("null")).alias("item")).where("file IS NOT NULL")
    items.sparkSession.dataSource.register(JsonListSource)
    dealt = rows.repartitionByRange("file").sortWithinPartitions("file", "pos")
    dealt.write.format("jsonlists").mode("overwrite").option("indent", indent).option("ascii", str(ascii).lower()).save(path)


# -- reading ---------------------------------------------------------------

def items_of(rows: DataFrame, text: str) -> DataFrame:
    """rows with pos int and item variant: one row for each element of the JSON array that `text` is; none for other texts."""
    parsed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"), F.try_parse_json(text).alias("_list"))
    pairs = parsed.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("_list").outer()))
    return pairs.where("key IS NULL").select("_row.*", "pos", F.col("value").alias("item"))


def kind_of(item: Column) -> Column:
    """object, array, string, number, boolean or null: what a JSON value is, whatever it looks like."""
    kind = F.schema_of_variant(item)
    return F.when(F.startswith(kind, F.lit("OBJECT")), "object").when(F.startswith(kind, F.lit("ARRAY")), "array").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").when(kind.isNotNull(), "number")


def field_kind(item: Column, field: str) -> Column:
    """kind_of a field of an object; null where there is none."""
    return kind_of(F.try_variant_get(item, f"$.{field}", "variant"))


def boolean_field(item: Column, field: str) -> Column:
    """A field that is true or false; null for what only looks like it, the text "true" and the number 1 among it."""
    return F.when(field_kind(item, field) == "boolean", F.try_variant_get(item, f"$.{field}", "boolean"))


def raw_text(item: Column) -> Column:
    """The text of an item that is a text, as it stands after a failed parse."""
    return F.when(kind_of(item) == "string", F.try_variant_get(item, "$", "string"))


def mixed_lists(spark: SparkSession, path: str) -> DataFrame:
    """path, name, pos, item variant, kind: the items of the JSON array in each file with their types; a file that is no array, or an empty one, has none."""
    found = items_of(whole_texts(spark, path, "*.json"), "value")
    return found.select("path", "name", "pos", "item", kind_of(F.col("item")).alias("kind"))

"""Book documents: S2-S8, S11, S12, V1, E1-E7, MP1.

A document's schema is fixed; validation adds the violations of each document as an array of texts, and
writers refuse documents that have any. A document is a file of its own.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import ROLES, TYPES

# The documents' properties and their types.
BOOK = (
    "schema_version string, id string, title string, author string, subject string, source_filename string, page_count int, cover_page int, created_at string, updated_at string, "
    "rendering struct<dpi:int,default_width_px:int,image_format:string>, chapters array<struct<id:string,title:string,start_page:int,end_page:int,level:int,order:int>>, tags array<string>"
)
PAGE = (
    "number int, source_number int, chapter_id string, width_px int, height_px int, rotation int, deskew_angle double, source_crop array<double>, block_order array<string>, "
    "problems array<struct<id:string,label:string,block_ids:array<string>,bbox:array<double>>>, thumbnail string, image string"
)
BLOCK = (
    "id string, page int, type string, bbox array<double>, order int, confidence double, problem_id string, "
    "reflow struct<role:string,full_width:boolean,keep_aspect:boolean,align:string,break_before:boolean,attach_to:string>, lines array<struct<bbox:array<double>,text:string>>, image string, text string, latex string"
)
PAGES = f"schema_version string, book_id string, pages array<struct<{PAGE.replace(' string', ':string').replace(' int', ':int').replace(' double', ':double').replace(' array', ':array')}>>"
BLOCKS = f"schema_version string, book_id string, blocks array<struct<{BLOCK.replace(' string', ':string').replace(' int', ':int').replace(' double', ':double').replace(' array', ':array').replace(' struct', ':struct')}>>"
SCHEMAS = {"book": BOOK, "pages": PAGES, "blocks": BLOCKS}

_TEXT, _TRUTH, _SHARE, _NUMBER = {"type": "string"}, {"type": "boolean"}, {"type": "number", "minimum": 0, "maximum": 1}, {"type": "number"}
_FROM_0, _FROM_1 = {"type": "integer", "minimum": 0}, {"type": "integer", "minimum": 1}
_VERSION = {"type": "string", "pattern": r"^\d+\.\d+$"}
_BOX = {"type": "array", "items": _SHARE, "size": 4}


def _list(items: dict) -> dict:
    return {"type": "array", "items": items}


def _object(required: str, **properties: dict) -> dict:
    return {"type": "object", "required": required.split(), "properties": properties}


# What each kind of document must, may and must not hold; no object may have other properties.
RULES = {
    "book": _object(
        "schema_version id title page_count created_at", schema_version=_VERSION, id={"type": "string", "pattern": r"^[a-z0-9][a-z0-9-]*$"}, title={"type": "string", "shortest": 1},
        author=_TEXT, subject=_TEXT, source_filename=_TEXT, page_count=_FROM_0, cover_page=_FROM_1, created_at=_TEXT, updated_at=_TEXT,
        rendering=_object("", dpi=_FROM_1, default_width_px=_FROM_1, image_format={"type": "string", "enum": ["webp", "png", "jpeg"]}),
        chapters=_list(_object("id title start_page", id=_TEXT, title=_TEXT, start_page=_FROM_1, end_page=_FROM_1, level=_FROM_0, order=_FROM_0)), tags=_list(_TEXT),
    ),
    "page": _object(
        "number width_px height_px", number=_FROM_1, source_number=_FROM_1, chapter_id=_TEXT, width_px=_FROM_1, height_px=_FROM_1, rotation={"type": "integer", "enum": [0, 90, 180, 270]}, deskew_angle=_NUMBER,
        source_crop=_BOX, block_order=_list(_TEXT), problems=_list(_object("id", id=_TEXT, label=_TEXT, block_ids=_list(_TEXT), bbox=_BOX)), thumbnail=_TEXT, image=_TEXT,
    ),
    "block": _object(
        "id page type bbox", id=_TEXT, page=_FROM_1, type={"type": "string", "enum": TYPES}, bbox=_BOX, order=_FROM_0, confidence=_SHARE, problem_id=_TEXT,
        reflow=_object("", role={"type": "string", "enum": list(ROLES.values())}, full_width=_TRUTH, keep_aspect=_TRUTH, align={"type": "string", "enum": ["left", "center", "right"]}, break_before=_TRUTH, attach_to=_TEXT),
        lines=_list(_object("bbox", bbox=_BOX, text=_TEXT)), image=_TEXT, text=_TEXT, latex=_TEXT,
    ),
}
RULES["pages"] = _object("schema_version book_id pages", schema_version=_VERSION, book_id=_TEXT, pages=_list(RULES["page"]))
RULES["blocks"] = _object("schema_version book_id blocks", schema_version=_VERSION, book_id=_TEXT, blocks=_list(RULES["block"]))


def _is(value: object, kind: str) -> bool:
    if kind in ("number", "integer"):
        return not isinstance(value, bool) and isinstance(value, (int, float)) and (kind == "number" or isinstance(value, int) or value.is_integer())
    return isinstance(value, {"string": str, "boolean": bool, "array": list, "object": dict}[kind])


def _found(value: object, rule: dict, name: str, path: str) -> list[str]:
    """What is wrong with a value; name: its property, path: where the object or list that holds it stands."""
    if value is None:
        return [f"{path}null {name}"]
    if not _is(value, rule["type"]):
        return [f"{path}type of {name}" if name else f"{path}not an object"]
    if rule["type"] == "object":
        inner = f"{path}{name} " if name else path
        missing = [f"{inner}missing {k}" for k in rule["required"] if k not in value]
        unknown = [f"{inner}unknown {k}" for k in sorted(value) if k not in rule["properties"]]
        return missing + unknown + [x for k, r in rule["properties"].items() if k in value for x in _found(value[k], r, k, inner)]
    if rule["type"] == "array":
        if "size" not in rule:
            return [x for i, v in enumerate(value) for x in _found(v, rule["items"], "" if rule["items"]["type"] == "object" else f"{name}[{i}]", f"{path}{name}[{i}] " if rule["items"]["type"] == "object" else path)]
        size = [f"{path}{name} size"] if len(value) != rule["size"] else []
        return size + ([f"{path}{name} range"] if any(_found(v, rule["items"], name, path) for v in value) else [])
    wrong = ("enum" in rule and value not in rule["enum"]) or ("pattern" in rule and not re.search(rule["pattern"], value)) or len(str(value)) < rule.get("shortest", 0)
    return [f"{path}{name}"] if wrong or ("minimum" in rule and value < rule["minimum"]) or ("maximum" in rule and value > rule["maximum"]) else []


def violations(text: Column, kind: str) -> Column:
    """V1: an array of what is wrong with a JSON text of this kind ("book", "pages", "blocks", one "page" or one "block"); empty if nothing is.

    Each text is parsed once. A violation names the property, after the objects and lists that it stands in; null and bad
    texts, texts after the document, and what is no object are "not an object". A list of numbers has one entry for its size
    and one for its values.
    """

    @F.arrow_udf("array<string>")
    def check(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            try:
                value = json.loads(t) if t is not None else None
            except ValueError:
                value = None
            out.append(_found(value, RULES[kind], "", "") if isinstance(value, dict) else ["not an object"])
        return pa.array(out, pa.list_(pa.string()))

    return check(text)


def read_documents(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Path, the document's fields, and violations, of each file; one without a document gives null fields."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    return raw.select("path", F.from_json("value", SCHEMAS[kind]).alias("d"), violations(F.col("value"), kind).alias("violations")).select("path", "d.*", "violations")


def valid(documents: DataFrame) -> DataFrame:
    """Documents without violations; raises if there is any."""
    bad = documents.filter(F.size("violations") > 0).select("path", "violations").head(1)
    if bad:
        raise ValueError(f"{bad[0].path}: {', '.join(bad[0].violations)}")
    return documents.drop("path", "violations")


def write_documents(documents: DataFrame, path: str, kind: str, mode: str = "overwrite") -> None:
    """A file for each document, as JSON, optional fields without value left out; nothing is written if any has violations."""
    text = documents.select(F.to_json(F.struct(*(c for c in documents.columns))).alias("value"))
    bad = text.select(violations(F.col("value"), kind).alias("v")).filter(F.size("v") > 0).head(1)
    if bad:
        raise ValueError(", ".join(bad[0].v))
    text.write.mode(mode).option("maxRecordsPerFile", 1).text(path)


def book_documents(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """Folder and document of all folders that have one of this kind."""
    found = read_documents(spark, f"{root}/*/{kind}.json", kind)
    return found.select(F.regexp_extract("path", rf"([^/]+)/{kind}\.json$", 1).alias("folder"), *found.columns[1:])


def ensure_book(book: DataFrame, path: str) -> None:
    """Written once; what is there stays."""
    write_documents(book, path, "book", mode="ignore")


def map_rows(text: Column, value: str = "string") -> Column:
    """S5, S7, MP1: a JSON object with numbers as keys, as an array of (key int, value), ascending; null and bad texts give none."""
    entries = F.map_entries(F.from_json(text, f"map<string,{value}>"))
    return F.coalesce(F.array_sort(F.transform(entries, lambda e: F.struct(e["key"].try_cast("int").alias("key"), e["value"].alias("value")))), F.array().cast(f"array<struct<key:int,value:{value}>>"))


def map_text(rows: Column) -> Column:
    """S5, MP1: the object of (key, value) rows."""
    return F.to_json(F.map_from_entries(F.transform(rows, lambda e: F.struct(e["key"].cast("string"), e["value"]))))


def last_page(text: Column) -> Column:
    """The page of a JSON text {"page": n}; null where there is no text or no such page."""
    return F.get_json_object(text, "$.page").try_cast("int")


def last_page_text(page: Column) -> Column:
    """S6."""
    return F.to_json(F.struct(page.alias("page")))


def read_last_page(spark: SparkSession, path: str) -> int | None:
    """Null without a file."""
    try:
        return spark.read.text(path, wholetext=True).select(last_page(F.col("value")).alias("p")).first().p
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def write_last_page(spark: SparkSession, page: int, path: str) -> None:
    """S6."""
    spark.range(1).select(last_page_text(F.lit(page)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


# Endings of page pictures, the one to be preferred first.
ENDINGS = ["webp", "png", "jpg"]


def first_image(pages: DataFrame, files: DataFrame) -> DataFrame:
    """For each page the ending of the file to be taken; null without any. files: page, ending."""
    order = F.array_position(F.array(*map(F.lit, ENDINGS)), F.col("ending"))
    best = files.withColumn("__o", order).filter("__o > 0").groupBy("page").agg(F.min_by("ending", "__o").alias("ending"))
    return pages.join(best, "page", "left")


def page_images(spark: SparkSession, folder: str) -> DataFrame:
    """Page, ending, content of the picture of each page in a folder, files named like 0007.png; only the files taken are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(ENDINGS) + "}").load(folder)
    named = files.select(F.regexp_extract("path", r"(\d+)\.(\w+)$", 1).try_cast("int").alias("page"), F.regexp_extract("path", r"\.(\w+)$", 1).alias("ending"), "path", "content").filter("page is not null")
    chosen = first_image(named.select("page").distinct(), named.select("page", "ending"))
    return named.join(chosen, ["page", "ending"], "left_semi").select("page", "ending", "content")


def book_index(spark: SparkSession, root: str) -> DataFrame:
    """Folders that have a book.json, by path."""
    books = spark.read.schema(BOOK).option("multiLine", True).json(f"{root}/*/book.json")
    return books.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/book\.json$", 1).alias("folder"), "id", "title", "page_count").orderBy("folder")

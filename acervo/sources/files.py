"""Files, registries and page tables as DataFrames (SRC-1..3, 5, 7, 8, 11..13)."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.functions import classes as C
from acervo.functions import text as X
from acervo.operators.filters import listed, type_set
from acervo.schema import DOC_SCHEMA

EXTENSIONS = ["pdf", "docx", "doc", "odt", "rtf", "txt", "png", "jpg", "jpeg", "webp"]
#: Code points of bytes 0x80..0x9f in Windows code page 1252 (fixed values; five bytes are undefined).
CP1252 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
CP1252_BYTES = [*range(0x80, 0x81), *range(0x82, 0x8D), 0x8E, *range(0x91, 0x9D), 0x9E, 0x9F]


def discover(spark: SparkSession, path: str) -> DataFrame:
    """SRC-1: supported files of a folder, any case; subfolders only if the folder itself has none."""
    glob = "*.{" + ",".join("".join(f"[{c.upper()}{c}]" for c in e) for e in EXTENSIONS) + "}"
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    flat = reader.load(path)
    return reader.option("recursiveFileLookup", "true").load(path) if flat.select("path").isEmpty() else flat


def fingerprint(files: DataFrame) -> DataFrame:
    """SRC-2: md5 of the bytes, file name, change time and extension."""
    return files.select(F.md5("content").alias("md5"), F.col("path").alias("caminho"), F.regexp_extract("path", r"([^/]+)$", 1).alias("nome_arquivo"), F.date_format("modificationTime", "dd/MM/yyyy HH:mm:ss").alias("data_modificacao"), F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("extensao"))


def read_registry(spark: SparkSession, path: str, target: DataFrame | None = None) -> DataFrame:
    """SRC-3: a JSON-array registry; a target that has rows stays as it is."""
    if target is not None and not target.isEmpty():
        return target
    return spark.read.schema(DOC_SCHEMA).option("multiLine", True).json(path)


def decode_text(content: Column | str) -> Column:
    """SRC-5: UTF-8 (with or without mark), else code page 1252, else ISO-8859-1 where 1252 has no such byte; stripped."""
    raw = X.col(content)
    utf = F.regexp_replace(raw.cast("string"), "^﻿", "")
    latin = F.decode(raw, "ISO-8859-1")
    windows = F.translate(latin, "".join(map(chr, CP1252_BYTES)), CP1252)
    return F.regexp_replace(F.when(F.is_valid_utf8(raw.cast("string")), utf).when(latin.rlike("[\x81\x8d\x8f\x90\x9d]"), latin).otherwise(windows), r"^\s+|\s+$", "")


def encode_rows(df: DataFrame) -> DataFrame:
    """SRC-7: keys trimmed and lower-cased, extension, domain and states filled in, lists as JSON."""
    ext = F.coalesce(X.nonblank("extensao"), X.nonblank(F.lower(F.regexp_extract("nome_arquivo", r"(\.[^./]+)$", 1))))
    out = df.withColumns({"md5": F.lower(F.trim("md5")), "extensao": ext, "dominio": F.coalesce(X.nonblank("dominio"), C.default_domain("tipo_documento", "valor_monetario")), "status": F.coalesce(X.nonblank("status"), F.lit("pendente")), "status_conferencia": F.coalesce(X.nonblank("status_conferencia"), F.lit("pendente"))})
    lists = [f.name for f in df.schema.fields if f.dataType.typeName() == "array"]
    return out.withColumns({c: F.to_json(c) for c in lists}).drop("data_criacao")


def decode_rows(df: DataFrame, promote: list[str] = ()) -> DataFrame:
    """SRC-8: list texts as arrays with the main class first, and overflow keys as columns where the row has none."""
    have = [c for c in promote if c in df.columns]
    bag = F.from_json("dados_extras", "map<string,string>")  # keys are never put into a path
    got = lambda k: F.try_element_at(bag, F.lit(k))
    out = df.withColumns({k: F.coalesce(X.nonblank(k), got(k)) if k in have else got(k) for k in promote})
    return out.withColumn("todos_tipos", type_set("tipo_documento", listed("todos_tipos_texto"))) if "todos_tipos_texto" in df.columns else out


def _paragraphs(name: str, content: bytes) -> tuple[str, dict[str, str]]:
    """Text and core properties of a .docx or .odt; nothing of what cannot be read."""
    parts = {"docx": ["word/document.xml"], "odt": ["content.xml"]}.get(name.lower().rpartition(".")[2])
    if not parts:
        return "", {}
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = z.namelist()
            parts = [*parts, *sorted(n for n in names if n.startswith(("word/header", "word/footer")))]
            lines = []
            for part in parts:
                for e in ElementTree.fromstring(z.read(part)).iter():
                    if e.tag.rpartition("}")[2] in ("p", "h") and (t := "".join(e.itertext()).strip()):
                        lines.append(t)
            core = {}
            if "docProps/core.xml" in names:
                core = {e.tag.rpartition("}")[2]: e.text for e in ElementTree.fromstring(z.read("docProps/core.xml")) if e.text}
            return "\n\n".join(lines), core
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return "", {}


# Core property names and their Dublin-Core fields.
CORE = {"title": "title", "creator": "creator", "subject": "subject", "description": "description", "keywords": "keywords", "lastModifiedBy": "contributor", "created": "date", "modified": "modified", "category": "type", "language": "language"}


def office_text(files: DataFrame) -> DataFrame:
    """SRC-11, SRC-12: (caminho, texto, dublin_core) of office files (path, content)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [_paragraphs(p, bytes(c)) for p, c in zip(b["path"], b["content"])]
            cores = []
            for _, core in got:
                d = {CORE[k]: v for k, v in core.items() if k in CORE}
                if "contributor" in d:
                    d.setdefault("creator_tool", d["contributor"])
                cores.append(d)
            yield pd.DataFrame({"caminho": b["path"], "texto": [t for t, _ in got], "dublin_core": cores})

    return files.select("path", "content").mapInPandas(run, "caminho string, texto string, dublin_core map<string,string>")


def html_metadata(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """SRC-12: title, language, charset, source host and meta tags of an HTML page table."""
    h = F.coalesce(F.col(html_col), F.lit(""))
    names, values = (F.regexp_extract_all(h, F.lit(r'(?i)<meta\s+name="([^"]+)"\s+content="([^"]*)"'), i) for i in (1, 2))
    meta = F.map_from_entries(F.transform(F.filter(F.arrays_zip(names.alias("k"), values.alias("v")), lambda x, i: F.array_position(F.transform(names, F.lower), F.lower(x["k"])) == i + 1), lambda x: F.struct(F.lower(x["k"]), x["v"])))
    one = lambda p: X.nonblank(F.regexp_extract(h, p, 1))
    return pages.select("page_id", one(r"(?is)<title>(.*?)</title>").alias("title"), one(r'(?i)<html[^>]*\slang="([^"]+)"').alias("language"), one(r'(?i)<meta\s+charset="([^"]+)"').alias("charset"), X.nonblank(F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)).alias("source"), meta.alias("meta"))


AUTHORITIES = ["ICP-Brasil", "Certisign", "Serasa", "Soluti", "Valid", "Serpro", "AC Safeweb", "Gov.br", "DocuSign"]


def inspect_signatures(files: DataFrame, text_col: str | None = None) -> DataFrame:
    """SRC-13: signed (by its marks within the first 2 MB), authorities, signer names, and native-digital (40 letters of text)."""
    text = F.decode(F.substring("content", 1, 2 << 20), "ISO-8859-1")
    signed = X.any_of(text, ["/ByteRange", "/Type /Sig", "/Type/Sig", "/SubFilter"])
    found = F.filter(F.array(*[F.lit(a) for a in AUTHORITIES]), lambda a: F.lower(text).contains(F.lower(a)))
    names = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"CN=([^,/)\n\r]+)"), 1), lambda n: F.trim(n)), lambda n: (F.length(n) > 3) & ~n.startswith("AC ")))
    native = F.length(F.trim(F.coalesce(text_col, F.lit("")))) >= 40 if text_col else F.lit(None).cast("boolean")
    return files.select("path", signed.alias("tem_assinatura_digital"), F.when(signed, found).alias("autoridades"), F.when(signed, names).alias("assinantes"), native.alias("eh_nativo_digital"))

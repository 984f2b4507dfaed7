"""Document loaders: files of many formats become rows (path, filename, partition, file_id, text, metadata).

Text formats are read by Spark's own sources and stay in the JVM; containers (mail, office files) are parsed with the
standard library in Arrow batches. Formats that need a model or a converter (PDF, images, audio, old office files) take a
registered parser: ``register(extension, parser)`` with ``parser(bytes) -> str``, or (text, contents of its embedded images), with ``images.mark_of``
at each image's place in the text.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.runtime import small_batches, staged
from quernstone.sources import images

Parser = Callable[[bytes], str | tuple[str, list[bytes]]]
_PARSERS: dict[str, Parser] = {}
NATIVE = {"txt": "text", "md": "text", "html": "html", "htm": "html"}


def register(extension: str, parser: Parser) -> None:
    """Use ``parser`` for files of this extension (lower case)."""
    _PARSERS[extension.lower()] = parser


def accepted() -> list[str]:
    return sorted({*NATIVE, *_PARSERS})


def decode(data: bytes) -> str:
    """Bytes as text: by byte-order mark, else UTF-8, else Windows Latin."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(name, "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace")


class _Visible(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def parse_html(data: bytes) -> str:
    """Text between tags, entities decoded; one page."""
    parser = _Visible()
    parser.feed(decode(data))
    return " ".join(" ".join(parser.parts).split()) + "\n[PAGE_1]\n"


def parse_mail(data: bytes) -> str:
    """The first body part of a mail."""
    import email
    from email import policy

    body = email.message_from_bytes(data, policy=policy.default).get_body(preferencelist=("plain", "html"))
    if body is None:
        return ""
    content = body.get_content()
    return parse_html(content.encode()).removesuffix("\n[PAGE_1]\n") if body.get_content_type() == "text/html" else content


def _texts(node: ElementTree.Element, tag: str) -> str:
    return "".join(t.text or "" for t in node.iter() if t.tag.endswith(tag))


def _relations(z: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """(kind, part) of what a part of an office file refers to, by id."""
    folder, _, name = part.rpartition("/")
    at = f"{folder}/_rels/{name}.rels"
    if at not in z.namelist():
        return {}
    out = {}
    for r in ElementTree.fromstring(z.read(at)):
        target = r.get("Target", "")
        path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"{folder}/{target}")
        out[r.get("Id")] = (r.get("Type", "").rpartition("/")[2], path)
    return out


def _attribute(node: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if k.rpartition("}")[2] == name), None)


def _pictures(node: ElementTree.Element, z: zipfile.ZipFile, relations: dict[str, tuple[str, str]], contents: list[bytes]) -> list[str]:
    """Marks of the images below a node, in order; their contents are added to ``contents``."""
    out = []
    alt = next((_attribute(e, "descr") or "" for e in node.iter() if e.tag.rpartition("}")[2] in ("docPr", "cNvPr")), "")
    for blip in (e for e in node.iter() if e.tag.endswith("}blip")):
        kind, part = relations.get(_attribute(blip, "embed"), ("", ""))
        if kind == "image" and part in z.namelist():
            contents.append(z.read(part))
            out.append(images.mark_of(contents[-1], alt))
    return out


def parse_docx(data: bytes) -> tuple[str, list[bytes]]:
    """Paragraphs in order; headings get # marks; images stand as marks at the end of their paragraph; page breaks end a page."""
    out, page, contents = [], 1, []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root, relations = ElementTree.fromstring(z.read("word/document.xml")), _relations(z, "word/document.xml")
        for p in root.iter():
            if not p.tag.endswith("}p"):
                continue
            style = next((v for e in p.iter() if e.tag.endswith("}pStyle") for k, v in e.attrib.items() if k.endswith("}val")), "")
            level = re.fullmatch(r"Heading(\d)", style)
            line = _texts(p, "}t").strip()
            if line:
                out.append(("#" * int(level[1]) + " " if level else "") + line)
            for drawing in (e for e in p.iter() if e.tag.endswith("}drawing")):
                out += _pictures(drawing, z, relations, contents)
            if any(e.tag.endswith("}br") and "page" in e.attrib.values() for e in p.iter()):
                out.append(f"[PAGE_{page}]")
                page += 1
    return "\n".join([*out, f"[PAGE_{page}]"]) + "\n", contents


def parse_odt(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("content.xml"))
    return "\n".join("".join(p.itertext()).strip() for p in root.iter() if p.tag.endswith(("}p", "}h"))) + "\n[PAGE_1]\n"


def _markdown(rows: list[list[str]]) -> list[str]:
    return ["| " + " | ".join(rows[0]) + " |", "|" + " --- |" * len(rows[0]), *("| " + " | ".join(r) + " |" for r in rows[1:])]


def chart_lines(root: ElementTree.Element) -> list[str]:
    """A chart part as a heading with its title and a table: a row for each category, a column for each series."""
    named = lambda node, name: next((e for e in node.iter() if e.tag.rpartition("}")[2] == name), None)

    def points(node: ElementTree.Element | None) -> dict[int, str]:
        return {int(p.get("idx", 0)): _texts(p, "}v") for p in node.iter() if p.tag.endswith("}pt")} if node is not None else {}

    title = named(root, "title")
    series = [e for e in root.iter() if e.tag.endswith("}ser")]
    names = [_texts(tx, "}v") if (tx := named(s, "tx")) is not None else "" for s in series]
    labels = points(named(series[0], "cat")) if series else {}
    values = [points(named(s, "val")) for s in series]
    rows = [["Category", *names]] + [[labels.get(i, ""), *(v.get(i, "") for v in values)] for i in sorted({*labels, *(i for v in values for i in v)})]
    heading = f"### Chart: {text}" if title is not None and (text := _texts(title, "}t").strip()) else "### Chart"
    return [heading, *_markdown(rows)]


def parse_pptx(data: bytes) -> tuple[str, list[bytes]]:
    """Slides in the presentation's order: title, text, pictures as marks, tables and charts as Markdown, notes, then the page marker."""
    out, contents = [], []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))
        if "ppt/presentation.xml" in z.namelist():
            order = _relations(z, "ppt/presentation.xml")
            listed = [order.get(_attribute(e, "id") if e.get("id") is None else next(v for k, v in e.attrib.items() if k.endswith("}id")), ("", ""))[1] for e in ElementTree.fromstring(z.read("ppt/presentation.xml")).iter() if e.tag.endswith("}sldId")]
            slides = [n for n in listed if n in slides] or slides
        for number, name in enumerate(slides, 1):
            relations = _relations(z, name)
            for shape in ElementTree.fromstring(z.read(name)).iter():
                kind = shape.tag.rpartition("}")[2]
                if kind == "pic":
                    out += _pictures(shape, z, relations, contents) or [images.PLACEHOLDER]
                elif kind == "graphicFrame":
                    rows = [[_texts(c, "}t").strip() for c in r if c.tag.endswith("}tc")] for r in shape.iter() if r.tag.endswith("}tr")]
                    if rows:
                        out += _markdown(rows)
                    for chart in (e for e in shape.iter() if e.tag.endswith("}chart")):
                        part = relations.get(_attribute(chart, "id"), ("", ""))[1]
                        if part in z.namelist():
                            out += chart_lines(ElementTree.fromstring(z.read(part)))
                elif kind == "sp":
                    title = any(e.tag.endswith("}ph") and e.get("type") in ("title", "ctrTitle") for e in shape.iter())
                    lines = [_texts(p, "}t") for p in shape.iter() if p.tag.endswith("}p")]
                    text = "\n".join(x for x in lines if x.strip())
                    if text:
                        out.append(f"# {text}" if title else text)
            notes = next((part for kind, part in relations.values() if kind == "notesSlide"), f"ppt/notesSlides/notesSlide{number}.xml" if not relations else "")
            if notes in z.namelist() and (text := _texts(ElementTree.fromstring(z.read(notes)), "}t").strip()):
                out.append(f"### Notes:\n{text}")
            out.append(f"\n[PAGE_{number}]\n")
    return "\n".join(out), contents


def parse_xlsx(data: bytes) -> str:
    """Each sheet as a Markdown table."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = [_texts(s, "}t") for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if s.tag.endswith("}si")] if "xl/sharedStrings.xml" in z.namelist() else []
        out = []
        for page, name in enumerate(sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), 1):
            for row in (r for r in ElementTree.fromstring(z.read(name)).iter() if r.tag.endswith("}row")):
                cells = [shared[int(_texts(c, "}v"))] if c.get("t") == "s" else _texts(c, "}v") or _texts(c, "}t") for c in row if c.tag.endswith("}c")]
                out.append("| " + " | ".join(cells) + " |")
            out.append(f"[PAGE_{page}]")
    return "\n".join(out) + "\n"


for _ext, _parser in (("eml", parse_mail), ("docx", parse_docx), ("pptx", parse_pptx), ("odt", parse_odt), ("xlsx", parse_xlsx)):
    register(_ext, _parser)


def scan_files(spark: SparkSession, folder: str, *, known: DataFrame | None = None, partition: str = "_default") -> DataFrame:
    """All files below ``folder`` but those whose (partition, file_id) ``known`` has: path, filename, file_id, partition,
    extension, file_size (bytes), created_at, content. The file_id is the path below the folder with slashes as dots."""
    base = folder.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    name = F.element_at(F.split("path", "/"), -1)
    below = F.element_at(F.split("path", re.escape(base.removeprefix("file://").lstrip("/") + "/")), -1)
    out = files.select(
        "path", name.alias("filename"), F.replace(below, F.lit("/"), F.lit(".")).alias("file_id"), F.lit(partition).alias("partition"),
        T.extension(name).alias("extension"), F.col("length").alias("file_size"), F.col("modificationTime").alias("created_at"), "content",
    )
    return out if known is None else out.join(known.select("partition", "file_id"), ["partition", "file_id"], "left_anti")


def decoded(content: Column) -> Column:
    """``decode`` in the JVM: by byte-order mark, else UTF-8 where it is valid, else Windows Latin."""
    mark = lambda n: F.hex(F.substring(content, 1, n))
    whole = content.cast("string")
    high = bytes(range(0x80, 0xA0))
    western = F.translate(F.decode(content, "iso-8859-1"), high.decode("latin-1"), high.decode("cp1252", "replace"))
    rest = F.when(F.is_valid_utf8(whole), whole).otherwise(western)
    return F.when(mark(3) == "EFBBBF", F.substring(content, 4, 1 << 30).cast("string")).when(mark(2).isin("FFFE", "FEFF"), F.decode(content, "UTF-16")).otherwise(rest)


def load_files(files: DataFrame, *, caption: Callable[[Column], Column] | None = None, caption_content: Callable[[Column], Column] | None = None) -> DataFrame:
    """scan_files rows with their text; files whose format nobody parses, or whose parser fails, get a null text and an error.

    Text, Markdown and HTML stay in the JVM; only other contents, and HTML with entities that ``html_to_text`` doesn't know, go to
    a parser. ``caption`` (of a link) and ``caption_content`` (of an embedded image's bytes) write the captions of the images of Markdown and office
    files, once for each distinct image (``images.caption_images``); without ``caption`` linked images stay as they are, without
    ``caption_content`` embedded ones become ``<image>``.
    """
    small_batches(files.sparkSession, 64)
    parsers = dict(_PARSERS)
    text = T.strip(decoded(F.col("content")))
    is_html = F.col("extension").isin("html", "htm")
    native = F.when(is_html, T.with_page_marker(T.html_to_text(decoded(F.col("content"))), F.lit(1))).otherwise(text)
    odd = F.rlike(decoded(F.col("content")), F.lit(r"&(?!(?:nbsp|lt|gt|quot|amp|#39|#160);)#?\w+;"))
    is_native = F.col("extension").isin(*NATIVE) & ~(is_html & odd)

    @F.pandas_udf("text string, error string, contents array<binary>")
    def parsed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for extensions, contents in batches:
            rows = []
            for ext, data in zip(extensions, contents):
                try:
                    if data is None:
                        rows.append((None, None, None))
                    elif ext in ("html", "htm"):
                        rows.append((parse_html(data), None, None))
                    elif ext in parsers:
                        made = parsers[ext](data)
                        rows.append((made, None, None) if isinstance(made, str) else (made[0], None, made[1]))
                    else:
                        rows.append((None, f"no parser for {ext!r}", None))
                except Exception as e:
                    rows.append((None, f"{type(e).__name__}: {e}", None))
            yield pd.DataFrame(rows, columns=["text", "error", "contents"])

    parts = files.withColumn("_p", parsed("extension", F.when(~is_native, F.col("content"))))
    parts = parts.withColumn("text", F.when(is_native, native).otherwise(F.col("_p.text"))).withColumn("error", F.col("_p.error")).withColumn("_contents", F.col("_p.contents")).drop("content", "_p")
    rows = staged(parts, "parsed")  # parsed once, for the texts and for the images
    inside = F.size(F.coalesce("_contents", F.array().cast("array<binary>"))) > 0
    illustrated = inside if caption is None else inside | (F.col("extension") == "md")
    contents = rows.filter(inside).select(F.explode("_contents").alias("content")).select(F.sha2("content", 256).alias("id"), "content")
    some = images.caption_images(rows.filter(illustrated).drop("_contents"), caption=caption, caption_content=caption_content, contents=contents)
    return rows.filter(~illustrated).drop("_contents").unionByName(some)


def read_texts(spark: SparkSession, folder: str, glob: str = "*.txt") -> DataFrame:
    """Whole text files, JVM only: path, text (decoded as ``decode`` does, stripped)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", T.strip(decoded(F.col("content"))).alias("text"))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines."""
    return spark.read.schema(schema).json(path)


def write_json(rows: DataFrame, path: str) -> None:
    """JSON lines, null fields included."""
    rows.write.option("ignoreNullFields", "false").json(path)


def save_markdown(docs: DataFrame, folder: str) -> None:
    """The text of each file (file_id, text) as Markdown below a directory of its own, ``file_id=<name>``."""
    docs.select("file_id", "text").write.option("lineSep", "\n").partitionBy("file_id").text(folder)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a header; quoted fields can hold line feeds."""
    return spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').schema(schema).csv(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """What read_csv reads."""
    rows.write.option("header", "true").option("quoteAll", "true").option("escape", '"').csv(path)


def corpus_rows(rows: DataFrame, *, min_words: int = 16, max_rows: int | None = None, order: str = "id") -> DataFrame:
    """Rows with more than ``min_words`` words, of the first ``max_rows`` in ``order``."""
    rows = rows.orderBy(order).limit(max_rows) if max_rows is not None else rows
    return rows.filter(T.word_count(F.col("text")) > min_words)


LOG = "timestamp timestamp, level string, message string, extra struct<task_id:string>"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines log: timestamp, level, message, task_id."""
    return spark.read.schema(LOG).json(path).select("timestamp", "level", "message", F.col("extra.task_id").alias("task_id"))


def log_tail(spark: SparkSession, path: str, task_id: str, n: int) -> DataFrame:
    """The last ``n`` entries of a task in a JSON-lines log, oldest first."""
    last = read_log(spark, path).filter(F.col("task_id") == task_id).orderBy(F.desc("timestamp"), F.desc("message")).limit(n)
    return last.orderBy("timestamp", "message")

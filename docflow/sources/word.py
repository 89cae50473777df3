"""Word packages: reading text groups with protected regions, and writing translated text back."""

from __future__ import annotations

import hashlib
import io
import os
import re
import tempfile
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Names and limits of the package format. Fixed values.
NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
W = f"{{{NS}}}"
PARTS = re.compile(r"word/(?:document|(?:header|footer)\d+)\.xml")
OPAQUE = frozenset(W + x for x in ("del", "fldSimple", "drawing", "object", "pict", "txbxContent", "sdt"))
# What ends a group beside opaque regions and fields: its place must stay between two groups. Fixed values.
BREAKS = frozenset(W + x for x in ("br", "tab", "cr", "instrText"))
MAX_BYTES, MAX_MEMBERS = 256 * 1024 * 1024, 20_000
SPACE = "{http://www.w3.org/XML/1998/namespace}space"


class BadPackage(ValueError):
    """A package that can't be read: broken, too large, or without a document part."""


def members(content: bytes) -> dict[str, bytes]:
    """Members of a package, checked for size, number, repeated names and damage."""
    if len(content) > MAX_BYTES:
        raise BadPackage("too large")
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            infos = z.infolist()
            if len(infos) > MAX_MEMBERS or sum(i.file_size for i in infos) > MAX_BYTES:
                raise BadPackage("too large")
            if len({i.filename for i in infos}) != len(infos):
                raise BadPackage("repeated member")
            if z.testzip():
                raise BadPackage("damaged member")
            out = {i.filename: z.read(i) for i in infos}
    except (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError) as e:
        raise BadPackage("no package") from e
    if "word/document.xml" not in out:
        raise BadPackage("no document")
    return out


def groups(root: ET.Element) -> list[list[ET.Element]]:
    """Runs of text nodes in order that nothing parts: not a break, a tab, a field, an opaque region, or the paragraph's end.

    Nodes in opaque regions and of field results are left out. A paragraph inside another has groups of its own after its owner's.
    The depth of open fields is carried from paragraph to paragraph, so a part is read from its beginning to its end.
    """
    paragraphs: list[list[list[ET.Element]]] = []
    depth = 0

    def walk(el: ET.Element, own: list[list[ET.Element]] | None) -> None:
        nonlocal depth
        for child in el:
            if child.tag in OPAQUE:
                if own is not None:
                    own.append([])
            elif child.tag == W + "p":
                paragraphs.append([[]])
                walk(child, paragraphs[-1])
            elif own is not None and child.tag == W + "fldChar":
                own.append([])
                depth = max(0, depth + {"begin": 1, "end": -1}.get(child.get(W + "fldCharType"), 0))
            elif own is not None and child.tag in BREAKS:
                own.append([])
            elif own is not None and child.tag == W + "t":
                if not depth:
                    own[-1].append(child)
            else:
                walk(child, own)

    walk(root, None)
    return [g for p in paragraphs for g in p if any(n.text for n in g)]


def parse(xml: bytes) -> ET.Element:
    for _, (prefix, uri) in ET.iterparse(io.BytesIO(xml), events=["start-ns"]):
        try:
            ET.register_namespace(prefix, uri)
        except ValueError:
            pass
    return ET.fromstring(xml)


def text_groups(content: bytes) -> list[tuple[str, int, list[str]]]:
    """(part, group number, texts of its nodes) of a package."""
    out = []
    for name, data in members(content).items():
        if PARTS.fullmatch(name):
            out += [(name, i, [n.text or "" for n in g]) for i, g in enumerate(groups(ET.fromstring(data)))]
    return out


def structure(content: bytes) -> tuple[int, ...]:
    """Numbers of sections, tables, rows and cells; a table with a row outside it or a cell outside a row is broken."""
    root = ET.fromstring(members(content)["word/document.xml"])
    rows = [r for t in root.iter(W + "tbl") for r in t.iter(W + "tr")]
    cells = sum(1 for r in rows for _ in r.iter(W + "tc"))
    if len(set(map(id, rows))) != sum(1 for _ in root.iter(W + "tr")):
        raise BadPackage("row outside a table")
    return sum(1 for _ in root.iter(W + "sectPr")), sum(1 for _ in root.iter(W + "tbl")), len(rows), cells


def rewrite(content: bytes, texts: dict[tuple[str, int], list[str]]) -> bytes:
    """The package with new texts of the nodes of some groups; other members and unchanged parts stay as they are, byte for byte."""
    data = members(content)
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        comment, infos = z.comment, z.infolist()
    for part in {p for p, _ in texts}:
        root, changed = parse(data[part]), False
        for i, g in enumerate(groups(root)):
            for node, new in zip(g, texts.get((part, i), [])):
                if (node.text or "") != new:
                    node.text, changed = new, True
                    if new != new.strip():
                        node.set(SPACE, "preserve")
        if changed:
            data[part] = ET.tostring(root, encoding="UTF-8", xml_declaration=True)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.comment = comment
        for i in infos:
            z.writestr(i, data[i.filename])
    return buffer.getvalue()


def validate(content: bytes, expected: tuple[int, ...]) -> str | None:
    """What is wrong with a written package, or null."""
    try:
        return None if content and structure(content) == expected else "structure"
    except (BadPackage, ET.ParseError) as e:
        return str(e) or "broken"


NODES = "part string, group_id int, node_ord int, text string"


def read_nodes(files: DataFrame) -> DataFrame:
    """path, sha256, error, part, group_id, node_ord, text of every text node of packages (path, content); unreadable ones give one row with an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "sha256", "error", "part", "group_id", "node_ord", "text"]
        types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sha = hashlib.sha256(content or b"").hexdigest()
                try:
                    rows = [(path, sha, None, part, g, k, t) for part, g, ts in text_groups(content or b"") for k, t in enumerate(ts)]
                except (BadPackage, ET.ParseError) as e:
                    rows = [(path, sha, str(e), None, None, None, None)]
                cols = list(zip(*rows)) if rows else [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return files.select("path", "content").mapInArrow(run, "path string, sha256 string, error string, " + NODES)


class WordReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, "rb") as f:
            content = f.read()
        for part, g, texts in text_groups(content):
            for k, t in enumerate(texts):
                yield partition.value, part, g, k, t


class WordSource(DataSource):
    """spark.read.format("word").load(folder): text nodes of the packages in a folder and below it, one task for each package."""

    @classmethod
    def name(cls) -> str:
        return "word"

    def schema(self) -> str:
        return "path string, " + NODES

    def reader(self, schema) -> WordReader:  # noqa: ANN001
        return WordReader(find(self.options["path"]))


def find(root: str) -> list[str]:
    """Packages in a folder and below it, in the order of a scan: no links, hidden files and working copies.

    A folder's own files come first, in the order of their names, then its folders in theirs.
    """
    if not os.path.exists(root):
        raise FileNotFoundError(root)
    if os.path.isfile(root):
        return [root]
    out = []
    for folder, folders, names in os.walk(root, followlinks=False):
        folders.sort()
        out += [os.path.join(folder, n) for n in sorted(names) if n.lower().endswith(".docx") and not re.match(r"~\$|\.", n) and not os.path.islink(os.path.join(folder, n))]
    return out


def asked_paths(paths: list[str]) -> list[str]:
    """Paths to scan in order: folders before files, short paths before long ones, then by name without case; each once.

    A path that isn't there is an error.
    """
    for p in paths:
        if not os.path.exists(p):
            raise FileNotFoundError(p)
    return sorted(dict.fromkeys(paths), key=lambda p: (not os.path.isdir(p), p.rstrip("/").count("/"), p.casefold()))


def scanned(spark: SparkSession, root: str) -> DataFrame:
    """path, name, length, status (file or skipped) of everything below a folder that any file system may hold; contents aren't read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    from docflow.operators.corpus import status

    return df.withColumn("status", status(F.col("name")))


def packages(spark: SparkSession, root: str) -> DataFrame:
    """path, length, content of the packages below a folder that any file system may hold; see ``scanned`` for what is passed over."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    from docflow.operators.corpus import status

    return df.where(status(F.element_at(F.split("path", "/"), -1)) == "file").select("path", "length", "content")


def publish(path: str, content: bytes, expected: tuple[int, ...], unchanged: Callable[[], bool] = lambda: True) -> str | None:
    """Write a package beside its place, check it, and link it there; never over an existing file. What went wrong, or null.

    ``unchanged`` is asked just before the link: whether the source still is what was read. The temporary file is always removed.
    """
    wrong = validate(content, expected)
    if wrong:
        return wrong
    folder = os.path.dirname(path) or "."
    os.makedirs(folder, exist_ok=True)
    fd, temporary = tempfile.mkstemp(prefix=".docflow-", dir=folder)
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(content)
        if not unchanged():
            return "changed"
        os.link(temporary, path)
        return None
    except FileExistsError:
        return "exists"
    finally:
        os.unlink(temporary)

"""Office documents and PDFs (EXT-7 to EXT-13, HSH-1 to HSH-4): links, text and content hashes from bytes.

Bytes are opened once per document, in Arrow batches; there is no PDF library, so PDF links come from the link annotations of plain and
deflated streams, without their text, and PDF text is not read.

Defined cases: null and empty bytes, unknown types and encrypted PDFs have no links and no error; broken containers give a parse error.
"""

from __future__ import annotations

import hashlib
import io
import re
import unicodedata
import zipfile
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.keys import col

# Extensions of the families, the link relation, parts that are properties.
FAMILIES = {"docx": ("docx", "docm", "dotx", "dotm"), "xlsx": ("xlsx", "xlsm", "xltx", "xltm"), "pptx": ("pptx", "pptm", "potx", "potm", "ppsx", "ppsm"), "pdf": ("pdf",)}
LINK_RELATION = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/hyperlink"
PROPERTY_PART = re.compile(r"docProps/|customXml/|\[Content_Types\]\.xml$|_rels/\.rels$")
CONTENT_ALGO, FULL_ALGO = "ooxml-content-v1", "full-sha256"
SCANNED = "file_ref string, file_type string, content_hash string, algo string, text string, links array<struct<raw_url:string,url:string,text:string,context:string,source:string>>, parse_error string"


def file_type(name: Column | str) -> Column:
    """EXT-7: docx, xlsx, pptx, pdf or unsupported, by the last extension of a name."""
    ext = F.lower(F.regexp_extract(F.regexp_extract(F.coalesce(col(name), F.lit("")), r"^([^?#]*)", 1), r"\.([^.]*)$", 1))
    out = F.lit("unsupported")
    for family, extensions in FAMILIES.items():
        out = F.when(ext.isin(*extensions), F.lit(family)).otherwise(out)
    return out


def xml_text(s: str) -> str:
    """Entities of XML, ``&amp;`` last, so that nothing is decoded twice."""

    def point(m: re.Match) -> str:
        n = int(m[1], 16) if m[0][2] in "xX" else int(m[1])
        return chr(n) if 0 < n <= 0x10FFFF else m[0]

    s = re.sub(r"&#([0-9]+);", point, re.sub(r"&#x([0-9a-fA-F]+);", point, s))
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        s = s.replace(name, char)
    return s


def _attributes(chunk: str) -> dict[str, str]:
    return {m[1]: m[2] if m[2] is not None else m[3] for m in re.finditer(r"""([\w:]+)=(?:"([^"]*)"|'([^']*)')""", chunk)}


def _elements(xml: str, name: str) -> Iterator[tuple[dict[str, str], str]]:
    """(attributes, inner text) of elements with or without content."""
    for m in re.finditer(rf"<{name}(?=[\s/>])([^>]*?)(?:/>|>(.*?)</{name}>)", xml, re.S):
        yield _attributes(m[1]), m[2] or ""


def _texts(xml: str, name: str) -> list[str]:
    return [m[1] for m in re.finditer(rf"<{name}(?:\s[^>]*)?>(.*?)</{name}>", xml, re.S)]


def _tags(xml: str, name: str) -> Iterator[dict[str, str]]:
    return (_attributes(m[1]) for m in re.finditer(rf"<{name}\s+([^>]*?)/?>", xml))


class _Package:
    """The parts of a zip container, each read once."""

    def __init__(self, data: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = [i.filename for i in self.zip.infolist() if not i.is_dir()]
        self._known: dict[str, str] = {}

    def text(self, name: str) -> str:
        if name not in self._known:
            self._known[name] = self.zip.read(name).decode("utf-8", "replace") if name in self.names else ""
        return self._known[name]


def _relation(a: dict[str, str]) -> str | None:
    return a.get("r:id") or a.get("id")


def office_links(data: bytes, kind: str) -> list[dict]:
    """EXT-8 to EXT-11: the external hyperlinks of all parts, with owner, place, text and anchor."""
    package, out = _Package(data), []
    for rels in package.names:
        m = re.fullmatch(r"(.*?)_rels/([^/]+)\.rels", rels)
        if not m:
            continue
        relations = [a for a in _tags(package.text(rels), "Relationship") if a.get("Type") == LINK_RELATION and a.get("Target") and a.get("TargetMode", "").lower() != "internal"]
        if not relations:
            continue
        owner = m[1] + m[2]
        xml = package.text(owner)
        texts, places, ends = {}, {}, {}
        if kind == "xlsx":
            for a in _tags(xml, "hyperlink"):
                if (rid := _relation(a)) is not None:
                    places |= {rid: a["ref"]} if a.get("ref") else {}
                    texts |= {rid: xml_text(a["display"])} if a.get("display") else {}
        elif kind == "docx":
            for a, inner in _elements(xml, "w:hyperlink"):
                if (rid := _relation(a)) is not None:
                    said = "".join(map(xml_text, _texts(inner, "w:t"))).strip()
                    texts |= {rid: said} if said else {}
                    ends |= {rid: xml_text(a["w:anchor"])} if a.get("w:anchor") else {}
        else:
            for run in _texts(xml, "a:r"):
                rid = next((_relation(a) for a in _tags(run, "a:hlinkClick")), None)
                said = "".join(map(xml_text, _texts(run, "a:t"))).strip()
                if rid and said:
                    texts[rid] = said
        for a in relations:
            rid, target = a.get("Id", ""), xml_text(a["Target"])
            where = f"{owner}!{places[rid]}" if rid in places else owner if owner in package.names else rels
            out.append({"raw_url": target, "url": f"{target}#{ends[rid]}" if rid in ends else target, "text": texts.get(rid), "context": where, "source": "rels"})
    return out


def _pdf_string(raw: bytes) -> str:
    def one(m: re.Match) -> bytes:
        x = m[1]
        return bytes([int(x, 8) & 255]) if x.isdigit() else {b"n": b"\n", b"r": b"\r", b"t": b"\t"}.get(x, b"" if x in (b"\n", b"\r") else x)

    return re.sub(rb"\\([0-7]{1,3}|.|\n)", one, raw, flags=re.S).decode("utf-8", "replace")


def pdf_links(data: bytes) -> list[dict]:
    """EXT-12: the targets of link annotations, with the page where pages and annotations are plainly written; encrypted files have none."""
    if not data.lstrip()[:5] == b"%PDF-":
        raise ValueError("not a PDF")
    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
        return []
    chunks = [data]
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", data, re.S):
        try:
            chunks.append(zlib.decompress(m[1]))
        except zlib.error:
            continue
    objects = {m[1]: m[2] for c in chunks for m in re.finditer(rb"(?:^|\s)(\d+)\s+\d+\s+obj\b(.*?)endobj", c, re.S)}
    pages = [body for body in objects.values() if re.search(rb"/Type\s*/Page(?![a-zA-Z])", body)]
    page_of: dict[bytes, int] = {}
    for n, body in enumerate(pages, 1):
        for listed in re.findall(rb"/Annots\s*\[(.*?)\]", body, re.S):
            page_of |= {r: n for r in re.findall(rb"(\d+)\s+\d+\s+R", listed)}
    spans = [(k, b) for k, b in objects.items()] or [(b"", c) for c in chunks]
    out = []
    for key, body in spans:
        for m in re.finditer(rb"/URI\s*\(((?:\\.|[^\\()])*)\)", body, re.S):
            url = _pdf_string(m[1])
            if url and (b"/Link" in body or key == b""):
                out.append({"raw_url": url, "url": url, "text": None, "context": f"page={page_of[key]}" if key in page_of else None, "source": "annotation"})
    return out


def office_hash(data: bytes) -> str:
    """HSH-2: a hash over all parts but properties, so that saving again without a change keeps it."""
    package, outer = _Package(data), hashlib.sha256()
    for name in sorted(n for n in package.names if not PROPERTY_PART.match(n)):
        outer.update(name.encode() + b":" + hashlib.sha256(package.zip.read(name)).digest() + b"\n")
    return outer.hexdigest()


def content_hash(data: bytes, kind: str) -> tuple[str, str]:
    """HSH-3: (hash, algo); hashes of different algos are never equal."""
    if kind in ("docx", "xlsx", "pptx"):
        try:
            return office_hash(data), CONTENT_ALGO
        except (zipfile.BadZipFile, zlib.error, ValueError, KeyError, EOFError, NotImplementedError, RuntimeError):
            pass
    return hashlib.sha256(data).hexdigest(), FULL_ALGO


def document_text(data: bytes, kind: str) -> str:
    """HSH-4: the normal form of a document's text; "" where it cannot be read."""
    try:
        if kind == "docx":
            raw = xml_text(" ".join(_texts(_Package(data).text("word/document.xml"), "w:t")))
        elif kind == "xlsx":
            package = _Package(data)
            shared = [xml_text(" ".join(_texts(package.text("xl/sharedStrings.xml"), "t")))] if "xl/sharedStrings.xml" in package.names else []
            sheets = sorted(n for n in package.names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n))
            raw = " ".join([*shared, *(xml_text(v) for n in sheets for v in _texts(package.text(n), "v"))])
        elif kind == "pptx":
            package = _Package(data)
            slides = sorted(n for n in package.names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n))
            raw = " ".join(xml_text(" ".join(_texts(package.text(n), "a:t"))) for n in slides)
        else:
            return ""
    except (zipfile.BadZipFile, zlib.error, ValueError, KeyError, EOFError, NotImplementedError, RuntimeError):
        return ""
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", raw).lower()).strip()


def scan_one(name: str, kind: str, data: bytes | None) -> tuple:
    """EXT-13: one document's row of SCANNED without its reference."""
    if not data:
        return kind, None, None, "", [], None
    digest, algo = content_hash(data, kind)
    error, links = None, []
    try:
        links = pdf_links(data) if kind == "pdf" else office_links(data, kind) if kind in ("docx", "xlsx", "pptx") else []
    except Exception as e:  # a document that cannot be read is a row with its error, as the others go on
        error = f"{type(e).__name__}: {e}"[:500]
    return kind, digest, algo, document_text(data, kind), links, error


def scan_documents(files: DataFrame) -> DataFrame:
    """EXT-13, EXT-14: links, hashes and text of file_ref, file_name, content; one row per file."""

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        link = pa.struct([(k, pa.string()) for k in ("raw_url", "url", "text", "context", "source")])
        names = ["file_ref", "file_type", "content_hash", "algo", "text", "links", "parse_error"]
        types = [pa.string()] * 5 + [pa.list_(link), pa.string()]
        for batch in batches:
            rows = [(r, *scan_one(r, k, c.as_py())) for r, k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2))]
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return files.select("file_ref", file_type("file_name").alias("file_type"), "content").mapInArrow(scan, SCANNED)


def scan_changed(files: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """EXT-14: (files to scan, files unchanged): a file whose etag is that of its known state, and not empty, is not read again."""
    before = known.select("file_ref", F.nullif("etag", F.lit("")).alias("_etag")).filter("_etag is not null").distinct()
    same = (files["file_ref"] == before["file_ref"]) & (files["etag"] == before["_etag"])
    return files.join(before, same, "left_anti"), files.join(before, same, "left_semi")

"""Files to text: folders, decoding, DOCX, page layouts and taxonomy tables."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SUFFIXES = "*.{pdf,docx,txt,PDF,DOCX,TXT}"


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modificationTime, length, content) of the folder's documents, not of its subfolders'."""
    return spark.read.format("binaryFile").option("pathGlobFilter", SUFFIXES).load(folder)


def role(path: Column, cv_dir: str, job_dir: str) -> Column:
    parent = F.regexp_replace(path, r"/[^/]*$", "")
    ends = lambda d: F.endswith(parent, F.lit(d.rstrip("/")))
    return F.when(ends(cv_dir), "cv").when(ends(job_dir), "job")


def decode(data: bytes) -> str:
    """UTF-8, else Windows-1252, else Latin-1."""
    for name in ("utf-8", "cp1252", "latin-1"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return ""


def docx_text(data: bytes) -> str:
    """Headers, the body in document order (table cells by tabs, text boxes as lines of their own), footers."""

    def paragraph(p) -> str:
        return "".join((t.text or "") if t.tag == W + "t" else "\t" if t.tag == W + "tab" else "\n" if t.tag in (W + "br", W + "cr") else "" for t in p.iter() if not inside_box(p, t))

    def inside_box(p, t) -> bool:
        return t in boxed.get(p, ())

    def blocks(e) -> list[str]:
        out = []
        for child in e:
            if child.tag == W + "p":
                for box in child.iter(W + "txbxContent"):
                    boxed.setdefault(child, set()).update(box.iter())
                out.append(paragraph(child))
                for box in child.iter(W + "txbxContent"):
                    out += blocks(box)
            elif child.tag == W + "tbl":
                for row in child.iter(W + "tr"):
                    out.append("\t".join(" ".join(x for x in blocks(cell) if x) for cell in row.iter(W + "tc")))
            elif child.tag == W + "sdt":
                for inner in child.iter(W + "sdtContent"):
                    out += blocks(inner)
        return out

    boxed: dict = {}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        part = lambda n: blocks(ElementTree.fromstring(z.read(n)))
        found = [x for n in sorted(names) if n.startswith("word/header") for x in part(n)]
        body = ElementTree.fromstring(z.read("word/document.xml")).find(W + "body")
        found += blocks(body) if body is not None else []
        found += [x for n in sorted(names) if n.startswith("word/footer") for x in part(n)]
    return "\n".join(x for x in found if x.strip())


def extract(files: DataFrame, pdf=None) -> DataFrame:
    """(path, text) of scan(): by suffix; an unreadable file gives an empty text. pdf: a function of bytes, if any."""

    def one(path: str, data: bytes) -> str:
        try:
            kind = path.lower().rsplit(".", 1)[-1]
            return decode(data) if kind == "txt" else docx_text(data) if kind == "docx" else pdf(data) if pdf else ""
        except Exception:  # a broken file is a file without text
            return ""

    def run(batches):
        for b in batches:
            pairs = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in pairs], pa.string()), pa.array([one(p, d or b"") for p, d in pairs], pa.string())], ["path", "text"])

    return files.select("path", "content").mapInArrow(run, "path string, text string")


def gutters(lines: DataFrame, width: str = "width") -> DataFrame:
    """(doc_id, page, gutter): the middle of the widest gap between the lines' spans, if it takes 2 % of the page's
    width, else its middle. lines: doc_id, page, x0, x1, width."""
    w = Window.partitionBy("doc_id", "page").orderBy("x0", "x1")
    before = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    gaps = lines.withColumn("_b", before).withColumn("_g", F.col("x0") - F.col("_b"))
    best = F.max(F.struct(F.col("_g").alias("g"), ((F.col("x0") + F.col("_b")) / 2).alias("m")))
    out = gaps.groupBy("doc_id", "page").agg(best.alias("_m"), F.max(width).alias("_w"))
    return out.select("doc_id", "page", F.when(F.col("_m.g") >= 0.02 * F.col("_w"), F.col("_m.m")).otherwise(F.col("_w") / 2).alias("gutter"))


def reading_order(lines: DataFrame, least: float = 0.15) -> DataFrame:
    """(doc_id, page, text): lines in order. Where left and right of the gutter each hold enough of the characters:
    full-width lines above, the left column, the right one, full-width lines below; else from top to bottom."""
    rows = lines.join(gutters(lines), ["doc_id", "page"])
    side = F.when(F.col("x1") <= F.col("gutter"), "left").when(F.col("x0") >= F.col("gutter"), "right").otherwise("full")
    rows = rows.withColumn("side", side)
    p = Window.partitionBy("doc_id", "page")
    chars = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.length("text"))).over(p), F.lit(0))
    total = F.sum(F.length("text")).over(p)
    two = (chars("left") >= least * total) & (chars("right") >= least * total)
    top = F.min(F.when(F.col("side") != "full", F.col("y0"))).over(p)
    zone = F.when(F.col("side") == "left", 1).when(F.col("side") == "right", 2).when(F.col("y0") < top, 0).otherwise(3)
    rows = rows.withColumn("_z", F.when(two, zone).otherwise(0))
    ordered = F.array_sort(F.collect_list(F.struct("_z", "y0", "x0", "text")))
    return rows.groupBy("doc_id", "page").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))


def plausible_table(rows: Column) -> Column:
    """Two rows and more, no cell with five line ends."""
    return (F.size(rows) >= 2) & ~F.exists(rows, lambda r: F.exists(r, lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"))) >= 5))


def render_table(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: F.regexp_replace(F.trim(c), r"\s*\n\s*", " ")), "\t")), "\n")


CELL = 100.0  # points: a page has some fifty cells


def outside_tables(lines: DataFrame, boxes: DataFrame, cell: float = CELL) -> DataFrame:
    """Lines whose centre lies in no table's box of their page. Boxes are dealt to the cells of a grid that they cover, so
    that a line meets those of its own cell alone; a line without a page or place lies in none."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    good = boxes.filter("x0 <= x1 and y0 <= y1").select(F.col("doc_id").alias("_d"), F.col("page").alias("_p"), *[F.col(c).alias(f"_{c}") for c in ("x0", "x1", "y0", "y1")])
    dealt = good.withColumn("_gx", span("_x0", "_x1")).withColumn("_gy", span("_y0", "_y1"))
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    same = (F.col("doc_id") == F.col("_d")) & (F.col("page") == F.col("_p")) & (F.floor(x / cell) == F.col("_gx")) & (F.floor(y / cell) == F.col("_gy"))
    return lines.join(dealt, same & x.between(F.col("_x0"), F.col("_x1")) & y.between(F.col("_y0"), F.col("_y1")), "left_anti")


def ocr_reason(text: Column, images: Column) -> Column:
    """Why a page should be read optically: empty, unreadable, sparse; null if it need not."""
    t = F.trim(F.coalesce(text, F.lit("")))
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    good = F.size(F.filter(words, lambda w: w.rlike(r"^[\p{L}\p{N}’'.,;:()/@+#%€&-]+$") & w.rlike(r"[aeiouyAEIOUYéèêàâîïôùûüöä0-9]")))
    return F.when(F.length(t) < 20, "empty").when(good < 0.5 * F.size(words), "unreadable").when((images >= 0.5) & (F.length(t) < 1500), "sparse")


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt to as many tasks as the cluster runs at once, where their files would make fewer: a small table that is
    one row group would have all its texts worked on by one core. Larger tables stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def markdown_sections(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, heading, body) of # headings; lines before the first one have a null heading."""
    ls = docs.select(id_, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    head = F.when(F.col("line").rlike(r"^#{1,6}\s+\S"), F.trim(F.regexp_replace("line", r"^#{1,6}\s+", "")))
    w = Window.partitionBy(id_).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ls = ls.withColumn("_h", head).withColumn("_n", F.count("_h").over(w)).withColumn("heading", F.last("_h", ignorenulls=True).over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_h").isNull(), F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    return ls.groupBy(id_, "_n", "heading").agg(F.trim(body).alias("body")).drop("_n")


def taxonomy_csv(spark: SparkSession, path: str) -> DataFrame:
    """(uri, label, alias): the preferred label and each line of the alternative ones."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    names = F.concat(F.array("preferredLabel"), F.filter(F.split(F.coalesce("altLabels", F.lit("")), "\n"), lambda x: F.trim(x) != ""))
    return rows.select(F.col("conceptUri").alias("uri"), F.col("preferredLabel").alias("label"), F.explode(names).alias("alias"))


def alias_json(spark: SparkSession, path: str, layer: int) -> DataFrame:
    """(layer, canonical, alias) of a JSON object of lists."""
    text = spark.read.text(path, wholetext=True)
    m = F.from_json("value", "map<string,array<string>>")
    return text.select(F.explode(m).alias("canonical", "aliases")).select(F.lit(layer).alias("layer"), "canonical", F.explode("aliases").alias("alias"))


def watch(spark, folder: str):
    """A stream of a folder's new and changed files, not of folders below it: (event_type, path, observed_at,
    fingerprint). folder_events.changes() has changes, moves and deletions as well, without the files' content."""
    files = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("pathGlobFilter", SUFFIXES).load(folder)
    return files.select(F.lit("created").alias("event_type"), "path", F.col("modificationTime").alias("observed_at"), F.sha2("content", 256).alias("fingerprint"))

"""Tab-separated text scans and sinks.

Three on-disk layouts are understood:

* **sample-major** (genotype or phenotype table): a header line
  ``<id label> \\t name_1 ... name_p``, then one line per sample
  ``id \\t v_1 ... v_p``.
* **marker-major**: a header line with ``lead`` leading columns followed by the
  sample names, then one line per marker: name, ``lead-1`` ignored cells, one
  value per sample.
* **combined matrix**: line 1 ``n_traits \\t n_features \\t n_samples``, line 2
  the feature names, then purely numeric rows ``traits..., features...``.

Everything stays a DataFrame; only the header line (p names) is read on the
driver, the way a header-aware reader does.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import to_double_array

TAB = "\t"
# position of a line: file, and start of the file's split that holds it
LINE_PLACE = ("_file", "_split")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines (``value``) with their place. Scans deal splits to tasks by size,
    so neither partitions nor files come in name order; the place columns say
    where a line belongs."""
    return spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_split"))


def head_lines(lines: DataFrame, n: int = 1) -> list[str]:
    """The first ``n`` lines: of the first file by name, else of the frame."""
    if all(c in lines.columns for c in LINE_PLACE):
        first = lines.agg(F.min("_file")).first()[0]
        lines = lines.where((F.col("_file") == first) & (F.col("_split") == 0))
    return [r["value"] for r in lines.select("value").take(n)]


@dataclass
class LabeledMatrix:
    """A keyed dense matrix plus its column dictionary.

    ``df`` has ``sample_id`` and one ``array<double>`` column named
    ``vector_col``; ``names`` has ``idx int`` (0-based) and ``name string``.
    """

    df: DataFrame
    names: DataFrame
    vector_col: str = "features"

    def long(self) -> DataFrame:
        """Long form ``(sample_id, idx, value)``."""
        return self.df.select("sample_id", F.posexplode(self.vector_col).alias("idx", "value"))

    def width(self) -> int:
        return self.names.count()


def _cells(line: Column) -> Column:
    # Java's String.split drops trailing empty cells; Spark's split keeps
    # them, so strip trailing tabs first to read the same cells.
    return F.split(F.rtrim(line, F.lit(TAB)), TAB)


def header_names(header: DataFrame, skip: int = 1) -> DataFrame:
    """Dictionary ``(idx, name)`` from a one-line header DataFrame."""
    cells = _cells(F.col("value"))
    return (header.select(F.posexplode(F.slice(cells, skip + 1, 1 << 30)).alias("idx", "name"))
            .select(F.col("idx").cast("int"), "name"))


def parse_sample_major(lines: DataFrame, vector_col: str = "features",
                       lenient: bool = False, header: str | None = None,
                       keep_text: bool = False, keep: list[str] = ()) -> LabeledMatrix:
    """Parse sample-major lines (column ``value``) into a LabeledMatrix.

    The header line is the first line (or the given text); every line equal
    to it is dropped, which also handles a folder of files that each repeat
    the header. Cell 0 is the id, kept as text (quotes included); the rest
    are cast to double; a bad cell, or a row of another width than the header,
    fails unless ``lenient``.
    ``keep_text`` also keeps the raw cells as ``<vector_col>_text``; ``keep``
    names columns of ``lines`` to carry along.
    """
    spark = lines.sparkSession
    if header is None:
        # read once on the driver, as in any header-aware reader
        first = head_lines(lines)
        if not first:
            raise ValueError("empty input: no header line")
        header = first[0]
    head = spark.createDataFrame([(header,)], "value string")
    # every copy of the header line is dropped (a folder of files each with
    # its own header); one literal comparison, no join
    body = lines.where(F.col("value") != F.lit(header))
    body = body.where(F.col("value").rlike("\\S"))
    cells = _cells(F.col("value"))
    width = len(header.rstrip(TAB).split(TAB))
    vector = F.slice(cells, 2, 1 << 30)
    values = F.when(F.col("value") == F.lit(header), F.lit(None))
    if not lenient:
        values = values.when(F.size(cells) != width, F.raise_error(F.concat(
            F.lit(f"a row does not have the header's {width} cells: "), F.element_at(cells, 1))))
    # guarded: Spark may evaluate inferred filters on this column before the
    # header filter, and a strict cast of the header cells would fail
    df = body.select(F.element_at(cells, 1).alias("sample_id"),
                     values.otherwise(to_double_array(vector, lenient)).alias(vector_col),
                     *([vector.alias(vector_col + "_text")] if keep_text else []), *keep)
    return LabeledMatrix(df, header_names(head), vector_col)


def read_sample_major(spark: SparkSession, path: str, vector_col: str = "features",
                      lenient: bool = False) -> LabeledMatrix:
    """Scan a sample-major TSV file or folder (genotype or phenotype table)."""
    return parse_sample_major(read_lines(spark, path), vector_col, lenient)


def read_traits(spark: SparkSession, path: str, lenient: bool = False,
                keep_text: bool = False) -> LabeledMatrix:
    """Phenotype table: same layout, vector column ``traits`` (and the raw
    cells as ``traits_text`` with ``keep_text``)."""
    return parse_sample_major(read_lines(spark, path), "traits", lenient, keep_text=keep_text)


def format_sample_major(df: DataFrame, vector_col: str, names: DataFrame,
                        id_label: str = "<Marker>") -> DataFrame:
    """Render a keyed matrix as sample-major TSV lines (header first).

    The header is built Spark-side from the dictionary; ``union`` keeps the
    header partition ahead of the data partitions, so ``limit(1)`` reads it.
    """
    # one group holding the p names of the dictionary (bounded by the width)
    head = (names.agg(F.concat_ws(TAB, F.lit(id_label),
                                  F.concat_ws(TAB, F.transform(
                                      F.array_sort(F.collect_list(F.struct("idx", "name"))),
                                      lambda s: s["name"]))).alias("value")))
    body = df.select(F.concat_ws(TAB, F.col("sample_id").cast("string"),
                                 F.concat_ws(TAB, F.transform(vector_col, lambda v: v.cast("string"))))
                     .alias("value"))
    return head.union(body)


@dataclass
class MarkerMajor:
    """Long form of a marker-major table plus its two dictionaries.

    ``long``: ``marker_idx int, sample_idx int, value double``;
    ``markers``: ``marker_idx, marker``; ``samples``: ``sample_idx, sample_id``.
    Names are attached after any regrouping, so the big long form is never
    shuffled just to carry a name.
    """

    long: DataFrame
    markers: DataFrame
    samples: DataFrame


def parse_marker_major(lines: DataFrame, lead: int = 5, lenient: bool = False) -> MarkerMajor:
    """Marker-major lines → long form.

    The marker index is the line position in file order (distributed row
    index, no driver pass); sample names are the cells of the first file's
    header after the ``lead`` leading columns, and copies of that line in
    other files are dropped. Values are cells ``lead+1 ...`` of each marker
    line, which must have as many cells as the header.
    """
    from ..operators.align import with_row_index

    place = [c for c in LINE_PLACE if c in lines.columns]
    header = head_lines(lines)
    if not header:
        raise ValueError("empty input: no header line")
    names = header[0].rstrip(TAB).split(TAB)[lead:]
    # every file may repeat the header
    body = lines.select("value", *place).where(
        (F.col("value") != F.lit(header[0]))
        & F.col("value").rlike("\\S"))
    indexed = with_row_index(body, "marker_idx").withColumn(
        "marker_idx", F.col("marker_idx").cast("int"))
    cells = _cells(F.col("value"))
    samples = lines.sparkSession.createDataFrame(list(enumerate(names)),
                                                 "sample_idx int, sample_id string")
    cast = (lambda v: v.try_cast("double")) if lenient else (lambda v: v.cast("double"))
    markers = indexed.select("marker_idx", F.element_at(cells, 1).alias("marker"))
    # a missing cell would shift every later one to another sample
    whole = F.when(F.size(cells) == lead + len(names), F.slice(cells, lead + 1, 1 << 30)) \
        .otherwise(F.raise_error(F.concat(
            F.lit(f"a marker line does not have the header's {lead + len(names)} cells: "),
            F.element_at(cells, 1))))
    long = indexed.select("marker_idx", F.posexplode(whole).alias("sample_idx", "cell"))
    long = long.select("marker_idx", F.col("sample_idx").cast("int").alias("sample_idx"),
                       cast(F.col("cell")).alias("value"))
    return MarkerMajor(long, markers, samples)


def read_marker_major(spark: SparkSession, path: str, lead: int = 5,
                      lenient: bool = False) -> MarkerMajor:
    return parse_marker_major(read_lines(spark, path), lead, lenient)


def read_marker_major_blocks(spark: SparkSession, paths: list[str], lead: int = 5,
                             lenient: bool = False) -> MarkerMajor:
    """One marker-major table in blocks of samples: every path has its own header
    line with its block's sample names, and the same markers in the same order
    (checked). Samples are numbered block after block, so no header line, and
    nothing the driver holds at a time, has more than a block's samples."""
    from ..operators.align import with_row_index
    from ..session import bounded_broadcast, written

    if not paths:
        raise ValueError("no marker-major blocks")
    # all blocks in one scan, whose lines are numbered once
    lines, _ = written(spark, read_lines(spark, paths).withColumn(
        "_at", F.monotonically_increasing_id()), "marker-lines")
    firsts = lines.where("_split = 0").groupBy("_file").agg(F.min("_at").alias("_at"))
    files = sorted(r["_file"] for r in firsts.select("_file").collect())
    block = dict(zip(files, _path_of(files, paths)))
    heads = _first_files(block, len(paths))
    if None in heads:
        raise ValueError("empty input: no header line")
    of_file = spark.createDataFrame([(f, block[f], heads[block[f]] == f) for f in files],
                                    "_file string, block int, head boolean")
    of_file = bounded_broadcast(of_file, len(files))
    names = lines.join(firsts, ["_file", "_at"]).join(of_file, "_file").where("head").select(
        "block", F.xxhash64("value").alias("_hash"), F.length("value").alias("_length"),
        F.slice(_cells(F.col("value")), lead + 1, 1 << 30).alias("names"))
    names, _ = written(spark, names, "marker-samples")
    sizes = sorted(names.select("block", F.size("names").alias("n"), "_hash", "_length").collect())
    shift, at = [], 0
    for k, n, h, size in sizes:
        shift.append((k, at, n, h, size))
        at += n
    shift = bounded_broadcast(spark.createDataFrame(
        shift, "block int, _shift long, _names int, _hash long, _length int"), len(sizes))
    samples = names.select("block", F.posexplode("names").alias("_k", "sample_id")).join(
        shift, "block").select((F.col("_shift") + F.col("_k")).alias("sample_idx"), "sample_id")
    # every file may repeat its block's header
    body = lines.join(of_file, "_file").join(shift, "block").where(
        ((F.xxhash64("value") != F.col("_hash")) | (F.length("value") != F.col("_length")))
        & F.col("value").rlike("\\S"))
    body = with_row_index(body.select("value", "block", "_shift", "_names", *LINE_PLACE), "_row")
    # the files of a block follow each other, and so do its lines
    first = body.groupBy("block").agg(F.min("_row").alias("_first"))
    body = body.join(bounded_broadcast(first, len(paths)), "block").withColumn(
        "marker_idx", (F.col("_row") - F.col("_first")).cast("int"))
    cells = _cells(F.col("value"))
    marker = body.select("block", "marker_idx", F.element_at(cells, 1).alias("marker"))
    marks = marker.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(
        "marker_idx", "marker").cast("decimal(20,0)")).alias("h"))
    kinds = marks.groupBy("n", "h").agg(F.count(F.lit(1)).alias("blocks")).collect()
    if kinds and (len(kinds) > 1 or kinds[0]["blocks"] != len(paths)):
        raise ValueError("blocks of samples hold different markers")
    cast = (lambda v: v.try_cast("double")) if lenient else (lambda v: v.cast("double"))
    # a missing cell would shift every later one to another sample
    whole = F.when(F.size(cells) == F.lit(lead) + F.col("_names"), F.slice(cells, lead + 1, 1 << 30)) \
        .otherwise(F.raise_error(F.concat(
            F.lit("a marker line does not have the header's number of cells: "),
            F.element_at(cells, 1))))
    long = body.select("marker_idx", "_shift", F.posexplode(whole).alias("_k", "cell")).select(
        "marker_idx", (F.col("_shift") + F.col("_k")).alias("sample_idx"),
        cast(F.col("cell")).alias("value"))
    return MarkerMajor(long, marker.where("block = 0").drop("block"), samples)


def _path_of(files: list[str], paths: list[str]) -> list[int]:
    """Which of ``paths`` (files or folders) holds each of ``files``."""
    from urllib.parse import unquote

    def bare(path: str) -> str:
        head, colon, tail = path.partition(":")
        tail = tail if colon and "/" not in head else path
        return re.sub("^//[^/]*", "", tail).rstrip("/")

    place = {bare(path): k for k, path in enumerate(paths)}
    out = []
    for f in files:
        for at in (bare(f), bare(unquote(f))):
            while at and at not in place:
                at = at.rpartition("/")[0]
            if at:
                out.append(place[at])
                break
        else:
            raise ValueError(f"a file of none of the blocks: {f}")
    return out


def _first_files(block: dict, n: int) -> list:
    """First file by name of every block."""
    heads: list = [None] * n
    for f in sorted(block, reverse=True):
        heads[block[f]] = f
    return heads


@dataclass
class CombinedMatrix:
    """``df``: ``traits``, ``features`` (``array<double>``); ``names``: ``idx,
    name`` of the features; the three counts of the first line."""

    df: DataFrame
    names: DataFrame
    n_traits: int
    n_features: int
    n_samples: int

    def check_rows(self, found: int) -> None:
        if found != self.n_samples:
            raise ValueError(f"the header declares {self.n_samples} samples, the matrix has {found}")


def parse_combined(lines: DataFrame, lenient: bool = False) -> CombinedMatrix:
    """Combined matrix with its two header lines.

    Both header lines are those of the first file by name; they are read on
    the driver, as metadata. The counts are checked against the names, and
    every row against the counts (unless ``lenient``); ``check_rows`` compares
    the declared number of samples with a row count that the caller has.
    Numeric rows need no position: only the two lines are taken out.
    """
    head = head_lines(lines, 2)
    if len(head) < 2:
        raise ValueError("a combined matrix starts with two header lines")
    counts = [c.strip() for c in head[0].rstrip(TAB).split(TAB)]
    if len(counts) != 3:
        raise ValueError(f"expected three counts in the first line, got {head[0]!r}")
    nt, nf, ns = (int(c) for c in counts)
    names = head[1].rstrip(TAB).split(TAB) if nf else []
    if len(names) != nf:
        raise ValueError(f"the header declares {nf} features and names {len(names)}")
    if all(c in lines.columns for c in LINE_PLACE):
        first = lines.agg(F.min("_file")).first()[0]
        at_head = (F.col("_file") == first) & (F.col("_split") == 0)
    else:
        at_head = F.lit(True)
    if nt + nf <= 3:
        # a row could read like a header line: take the lines out by position
        from ..operators.align import with_row_index

        place = [c for c in LINE_PLACE if c in lines.columns]
        body = with_row_index(lines.select("value", *place), "_line").where("_line >= 2")
        is_head = F.lit(False)
    else:
        is_head = at_head & F.col("value").isin(head)
        body = lines.where(~is_head)
    body = body.where(F.col("value").rlike("\\S"))
    cells = _cells(F.col("value"))
    vals = F.when(is_head, F.lit(None))
    if not lenient:
        vals = vals.when(F.size(cells) != nt + nf, F.raise_error(
            F.lit(f"a row does not have {nt} + {nf} cells")))
    vals = vals.otherwise(to_double_array(cells, lenient))
    df = body.select(F.slice(vals, F.lit(1), F.lit(nt)).alias("traits"),
                     F.slice(vals, F.lit(nt + 1), F.lit(1 << 30)).alias("features"))
    dictionary = lines.sparkSession.createDataFrame(list(enumerate(names)),
                                                    "idx int, name string")
    return CombinedMatrix(df, dictionary, nt, nf, ns)


def read_combined(spark: SparkSession, path: str, lenient: bool = False) -> CombinedMatrix:
    """Scan a combined-matrix file, or a folder whose first file by name starts
    with the two header lines."""
    return parse_combined(read_lines(spark, path), lenient)


def write_combined(rows: DataFrame, path: str, n_traits: int, feature_names: list[str],
                   n_samples: int, mode: str = "overwrite") -> None:
    """Write combined rows (``value``) under their two header lines. The header
    goes to the folder's first file by name; rows are written by their tasks."""
    import pyarrow as pa

    head = combined_header(n_traits, feature_names, n_samples)
    schema = pa.schema([pa.field("value", pa.string(), nullable=True)])

    def with_header(batches):
        from pyspark import TaskContext

        if TaskContext.get().partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array(head, pa.string())], schema=schema)
        for rb in batches:
            yield pa.RecordBatch.from_arrays([rb.column(0)], schema=schema)

    rows.select("value").mapInArrow(with_header, "value string").write.mode(mode).text(path)


def combined_header(n_traits: int, feature_names: list[str], n_samples: int) -> list[str]:
    return [TAB.join(str(v) for v in (n_traits, len(feature_names), n_samples)),
            TAB.join(feature_names)]


def write_sample_major(df: DataFrame, vector_col: str, names: DataFrame, path: str,
                       id_label: str = "<Marker>", mode: str = "overwrite") -> None:
    """Write a keyed matrix as sample-major TSV files, each with its header.

    Every output file starts with the header line (as a per-file CSV header
    would), so any file of the folder — and the folder as a whole — scans back
    with :func:`read_sample_major`. The header (p names) comes from the
    dictionary; the data lines never leave their tasks.
    """
    names_sorted = [r["name"] for r in names.orderBy("idx").select("name").collect()]
    body = df.select(F.concat_ws(TAB, F.col("sample_id").cast("string"),
                                 F.concat_ws(TAB, F.transform(vector_col,
                                                              lambda v: v.cast("string"))))
                     .alias("value"))
    write_with_header(body, path, TAB.join([id_label] + names_sorted), mode)


def write_with_header(lines: DataFrame, path: str, header: str, mode: str = "overwrite") -> None:
    """Write lines (``value``) as text files that each start with ``header``."""
    import pyarrow as pa

    schema = pa.schema([pa.field("value", pa.string(), nullable=True)])

    def with_header(batches):
        yield pa.RecordBatch.from_arrays([pa.array([header], pa.string())], schema=schema)
        for rb in batches:
            yield pa.RecordBatch.from_arrays([rb.column(0)], schema=schema)

    lines.select("value").mapInArrow(with_header, "value string").write.mode(mode).text(path)


def write_lines(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    lines.select("value").write.mode(mode).text(path)

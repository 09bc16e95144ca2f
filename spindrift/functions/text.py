"""Scalar text functions as Column expressions: chunking, sanitising, truncation, diffs, display."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Texts that results hold.
LINE_CUT = "...[line truncated]"
LINE_RESERVE = 20
HEX_TOKEN, BASE64_TOKEN = "HEX_TOKEN", "BASE64_TOKEN"
EMBEDDING_CUT = "\n\n[TRUNCATED - content exceeded embedding limits]"
SIZE_CUT = "\n\n[TRUNCATED - content exceeded max size]"
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java", ".cpp": "cpp", ".h": "cpp", ".inl": "cpp",
    ".c": "c", ".cs": "csharp", ".go": "go", ".rs": "rust", ".rb": "ruby", ".php": "php", ".swift": "swift", ".kt": "kotlin",
    ".scala": "scala", ".sql": "sql", ".sh": "bash", ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".xml": "xml",
    ".html": "html", ".css": "css", ".md": "markdown",
}

#: Possessive quantifiers: the alternatives exclude each other, so nothing is lost, and long runs don't recurse.
HEX_RUN = r"(?i)[\({]?(?:0[xXoObB]|&[hH])?(?:[0-9a-fA-F][\-,.:/ \t]*+){7,}+(?:[hHbBuUlLfFdD]++)?[\)}]?"
BASE64_RUN = r"[A-Za-z0-9+/_-]{32,}+={0,2}"


def sanitize(text: Column, hex_runs: bool = True, base64_runs: bool = True, replace: bool = False) -> Column:
    """Without long hexadecimal and base64 runs, or with a token in their place; hexadecimal ones go first."""
    if hex_runs:
        text = F.regexp_replace(text, HEX_RUN, HEX_TOKEN if replace else "")
    if base64_runs:
        text = F.regexp_replace(text, BASE64_RUN, BASE64_TOKEN if replace else "")
    return text


def chunk_fixed(text: Column, size: int) -> Column:
    """Slices of ``size`` code points; none for an empty text."""
    n = F.ceil(F.length(text) / size).cast("int")
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, (i - 1) * size + 1, F.lit(size)))
    return F.when(F.coalesce(F.length(text), F.lit(0)) > 0, cut).otherwise(F.array().cast("array<string>"))


def lines_packed(text: str, size: int) -> Iterator[tuple[str, int, int]]:
    """Whole lines packed into chunks of at most ``size`` code points, with the first and last line number."""
    if not text:
        return
    held: list[str] = []
    room, first = size, 1
    for number, line in enumerate(text.split("\n"), 1):
        if len(line) > size:
            line = line[: size - LINE_RESERVE] + LINE_CUT
        if held and len(line) + 1 > room:
            yield "\n".join(held), first, number - 1
            held, room, first = [], size, number
        held.append(line)
        room -= len(line) + 1
    yield "\n".join(held), first, first + len(held) - 1


def chunk_lines(df: DataFrame, text: str, size: int = 4096) -> DataFrame:
    """A row for each chunk of ``text``: the other columns, chunk_index, content, line_start, line_end.

    The fold over a text's lines runs in Arrow batches: the native fold would copy its growing output at each line.
    """
    keep = [c for c in df.columns if c != text]
    added = [("chunk_index", T.IntegerType()), ("content", T.StringType()), ("line_start", T.IntegerType()), ("line_end", T.IntegerType())]
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(c, t) for c, t in added)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, index, parts = [], [], []
            for i, value in enumerate(b.column(len(keep)).to_pylist()):
                for k, part in enumerate(lines_packed(value or "", size)):
                    row.append(i)
                    index.append(k)
                    parts.append(part)
            kept = [c.take(pa.array(row, pa.int64())) for c in b.columns[: len(keep)]]
            made = [pa.array(index, pa.int32()), *(pa.array([p[j] for p in parts], t) for j, t in enumerate((pa.string(), pa.int32(), pa.int32())))]
            yield pa.RecordBatch.from_arrays([*kept, *made], schema=arrow)

    return df.select(*keep, text).mapInArrow(run, schema)


def truncate_bytes(text: Column, most: int) -> Column:
    """The longest prefix of whole characters in ``most`` UTF-8 bytes."""
    raw = text.cast("binary")
    tries = [F.try_validate_utf8(F.substring(raw, 1, most - i).cast("string")) for i in range(4) if most - i > 0]
    return F.when(F.octet_length(text) <= most, text).otherwise(F.coalesce(*tries, F.lit("")))


def is_cut_by_bytes(text: Column, most: int) -> Column:
    return F.octet_length(text) > most


def truncate_tokens(text: Column, most: int, chars_per_token: float = 4.0) -> Column:
    """The text, or its first ``most * chars_per_token`` code points where it is estimated to have more than ``most`` tokens."""
    return F.when(F.length(text) / chars_per_token <= most, text).otherwise(F.substring(text, 1, int(most * chars_per_token)))


def truncate_for_embedding(diff: Column, most_bytes: int = 100_000, most_tokens: int = 8192) -> Column:
    cut = truncate_tokens(truncate_bytes(diff, most_bytes), most_tokens)
    return F.when(cut == diff, diff).otherwise(F.concat(cut, F.lit(EMBEDDING_CUT)))


def truncated_diff(diff: Column, most: int = 100_000) -> Column:
    return F.when(F.octet_length(diff) <= most, diff).otherwise(F.concat(truncate_bytes(diff, most), F.lit(SIZE_CUT)))


def is_binary(text: Column, sample: int = 8192) -> Column:
    """A NUL in the first bytes, or under 85 % of them printable ASCII, tab or line ends. Empty texts aren't binary."""
    head = F.decode(F.substring(text.cast("binary"), 1, sample), "ISO-8859-1")  # a character for each byte
    printable = F.length(F.regexp_replace(head, r"[^\x20-\x7E\t\n\r]", ""))
    odd = F.contains(head, F.lit("\x00")) | (printable / F.nullif(F.length(head), F.lit(0)) < 0.85)
    return F.coalesce(odd, F.lit(False))


def diff_filename(line: Column) -> Column:
    """The path that a diff's header line names; null for other lines."""
    header = F.regexp_extract(line, r"^diff --git a/(.*?) b/", 1)
    side = F.regexp_extract(line, r"^[+\-]{3} [ab]/(.*?)$", 1)
    return F.coalesce(F.nullif(header, F.lit("")), F.nullif(side, F.lit("")))


def diff_filenames(diff: Column) -> Column:
    """The distinct paths of a diff, sorted."""
    named = F.transform(F.split(diff, "\n", -1), diff_filename)
    return F.array_sort(F.array_distinct(F.filter(named, lambda x: x.isNotNull())))


def filter_binary(diff: Column, split_at: str = "diff --git ") -> Column:
    """struct(diff, binary_files): sections of binary files replaced by a two-line placeholder.

    ``split_at``: how a file's section begins; Perforce diffs have ``==== //`` there.
    """
    sections = F.split(diff, rf"\n(?={re.escape(split_at)})", -1)
    if split_at.startswith("===="):
        named = lambda s: F.nullif(F.regexp_extract(s, r"^==== (//[^#\n]+)", 1), F.lit(""))
    else:
        named = lambda s: F.get(F.filter(F.transform(F.split(s, "\n", -1), diff_filename), lambda x: x.isNotNull()), F.lit(0))
    found = F.transform(sections, lambda s: F.struct(s.alias("text"), named(s).alias("path"), is_binary(s).alias("binary")))
    gone = lambda x: x["binary"] & x["path"].isNotNull()
    note = lambda x: F.concat(F.lit("diff --git a/"), x["path"], F.lit(" b/"), x["path"], F.lit("\n[binary file: "), x["path"], F.lit("]"))
    kept = F.array_join(F.transform(found, lambda x: F.when(gone(x), note(x)).otherwise(x["text"])), "\n")
    binary = F.transform(F.filter(found, gone), lambda x: x["path"])
    plain = ~F.rlike(diff, F.lit(r"[^\x20-\x7E\t\n\r]"))  # no section of such a diff is binary, so it is read once and not taken apart
    return F.struct(F.when(plain, diff).otherwise(kept).alias("diff"), F.when(plain, F.array().cast("array<string>")).otherwise(binary).alias("binary_files"))


def metadata_text(message: Column, files: Column, comments: Column, most_files: int = 100, most_message: int = 4096, most_paths: int = 4096) -> Column:
    """What is embedded of a changelist: message, paths and review comments, each within its bytes, cut at whole paths."""
    over = F.octet_length(message) - most_message
    told = F.when(over > 0, F.concat(truncate_bytes(message, most_message), F.lit("\n[..."), over.cast("string"), F.lit(" bytes truncated]"))).otherwise(message)
    some = F.slice(files, 1, most_files)
    sizes = F.transform(some, lambda p, i: F.octet_length(p) + F.when(i == 0, 0).otherwise(2))
    none = F.struct(F.lit(0).alias("used"), F.lit(0).alias("fit"))
    step = lambda s, x: F.struct((s["used"] + x).alias("used"), (s["fit"] + F.when(s["used"] + x <= most_paths, 1).otherwise(0)).alias("fit"))
    fit = F.aggregate(sizes, none, step)["fit"]
    shown = F.array_join(F.slice(some, 1, fit), ", ")
    left = F.size(files) - fit
    paths = F.when(left > 0, F.concat(shown, F.lit("\n[..."), left.cast("string"), F.lit(" files omitted]"))).otherwise(shown)
    return F.concat_ws("\n", F.concat(F.lit("Commit Message: "), told), F.concat(F.lit("Files: "), paths), F.when(comments != "", F.concat(F.lit("Review Comments: "), comments)))


def preview(text: Column, most: int = 200) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def display_title(path: Column, first: Column, last: Column) -> Column:
    return F.format_string("%s (lines %d-%d)", path, first, last)


def language_of(path: Column) -> Column:
    """The name for fenced blocks by the path's extension; '' where it has none that is known. Leading dots begin no extension."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    ext = F.lower(F.regexp_extract(base, r"^\.*[^.].*?(\.[^.]*)$", 1))
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair)), ext), F.lit(""))


def split_list(text: Column) -> Column:
    """The trimmed items of a comma-separated list."""
    return F.filter(F.transform(F.split(text, ",", -1), lambda x: F.trim(x)), lambda x: x != "")


def unquoted(text: Column) -> Column:
    """Trimmed, without one pair of double and then one pair of single quotes around it."""
    text = F.trim(text)
    for q in ('"', "'"):
        text = F.when(F.startswith(text, F.lit(q)) & F.endswith(text, F.lit(q)), F.substring(text, F.lit(2), F.greatest(F.length(text) - 2, F.lit(0)))).otherwise(text)
    return text


def commit_range(first: Column, last: Column) -> Column:
    short = lambda c: F.substring(c, 1, 8)
    both = F.concat(F.lit("Range: "), short(first), F.lit(" → "), short(last))
    return F.when(first.isNotNull() & last.isNotNull(), both).when(last.isNotNull(), F.concat(F.lit("Only: "), short(last))).otherwise("No commits processed")


def diff_vector_id(commit: Column, index: Column) -> Column:
    return F.concat(commit, F.lit("_chunk_"), index.cast("string"))


def chunk_id(path: Column, index: Column) -> Column:
    return F.concat(F.lit("file:"), path, F.lit(":chunk_"), index.cast("string"))


def token_estimate(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded down."""
    return F.floor(F.octet_length(text) / 4).cast("long")


def epoch_to_timestamp(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def perforce_timestamp(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy/MM/dd HH:mm:ss"))


def iso_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def valid_name(name: Column) -> Column:
    """Letters, digits, hyphens and underscores only, one at least."""
    return F.coalesce(name.rlike(r"^[\p{L}\p{N}_-]+$"), F.lit(False))

"""Column -> Column expressions for text, paths and catalog fields.

Every function here returns a native Spark ``Column`` so it stays inside
Catalyst / whole-stage codegen; none of them is a Python UDF.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomlex.functions.constants import DIGITS, PUNCTUATION

ColumnOrName = Column | str

# Regular expressions (valid in both Java regex and RE2, so the same pattern
# text can be used by SQL oracles).
NON_ASCII_RE = r"[^\x00-\x7F]"
PUNCT_RUN_RE = r"[!-/:-@\[-`{-~]+"
DIGIT_RUN_RE = r"[0-9]+"
# Whitespace as split by Python's ``str.split()`` on ASCII text.
WHITESPACE_RUN_RE = r"[ \t\n\x0B\f\r\x1C-\x1F]+"
# os.path.splitext on the basename: leading dots do not start an extension.
FILE_EXT_RE = r"(?:^|/)\.*[^./][^/]*(\.[^./]*)$"


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --------------------------------------------------------------------------
# Document normalisation
# --------------------------------------------------------------------------

def ascii_only(c: ColumnOrName) -> Column:
    """Drop every non-ASCII character (``café`` -> ``caf``)."""
    return F.regexp_replace(_col(c), NON_ASCII_RE, "")


def strip_punctuation(c: ColumnOrName) -> Column:
    """Each run of ASCII punctuation becomes one space."""
    return F.regexp_replace(_col(c), PUNCT_RUN_RE, " ")


def strip_numeric(c: ColumnOrName) -> Column:
    """Digit runs are deleted (``abc123def`` -> ``abcdef``)."""
    return F.regexp_replace(_col(c), DIGIT_RUN_RE, "")


def remove_punctuation(c: ColumnOrName) -> Column:
    """Delete punctuation marks without leaving a space."""
    return F.translate(_col(c), PUNCTUATION, "")


def remove_digits(c: ColumnOrName) -> Column:
    """Delete digits."""
    return F.translate(_col(c), DIGITS, "")


def tokenize(c: ColumnOrName) -> Column:
    """Lowercase, split on whitespace runs, drop empty tokens."""
    parts = F.split(F.lower(_col(c)), WHITESPACE_RUN_RE)
    return F.filter(parts, lambda x: x != F.lit(""))


def prepare(c: ColumnOrName, keep_unicode: bool = False) -> Column:
    """N1 -> N2 -> N3 as one composed expression."""
    col = _col(c)
    if not keep_unicode:
        col = ascii_only(col)
    return strip_numeric(strip_punctuation(col))


def is_valid_utf8(content: ColumnOrName) -> Column:
    """N8 helper: true when a BINARY column holds valid UTF-8."""
    return F.is_valid_utf8(_col(content).cast("string"))


# --------------------------------------------------------------------------
# HTML / XML -> text
# --------------------------------------------------------------------------

SCRIPT_RE = r"(?is)<script[^>]*>.*?</script\s*>"
STYLE_RE = r"(?is)<style[^>]*>.*?</style\s*>"
COMMENT_RE = r"(?s)<!--.*?-->"
TAG_RE = r"<[^>]*>"
SPACE_RUN_RE = r"[ \t\n\x0B\f\r]+"

# One piece of a text: a run without ``&``, a whole reference, or a lone ``&``.
REFERENCE_RE = r"[^&]+|&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});|&"


def named_references() -> dict[str, str]:
    """HTML's named character references (from the standard library's table) and
    ``apos``; the no-break space becomes a plain one."""
    names = {n: chr(c) for n, c in name2codepoint.items()} | {"apos": "'"}
    return names | {"nbsp": " "}


def decode_text(content: ColumnOrName) -> Column:
    """Bytes as text: UTF-8 where valid, otherwise ISO-8859-1."""
    c = _col(content)
    return F.when(F.is_valid_utf8(c.cast("string")), c.cast("string")).otherwise(F.decode(c, "ISO-8859-1"))


def _reference(piece: Column) -> Column:
    """The character of a reference; anything else as it is."""
    names = named_references()
    table = F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair])
    inner = F.regexp_extract(piece, "^&#?([^;]+);$", 1)
    hexed = F.lower(F.substring(piece, 3, 1)) == "x"
    code = F.when(hexed, F.conv(F.regexp_replace(inner, "^[xX]", ""), 16, 10)) \
        .otherwise(inner).cast("bigint")
    legal = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    numeric = F.when(code == 160, F.lit(" ")).when(legal, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    return (F.when(~piece.rlike("^&.+;$"), piece)
            .when(piece.startswith("&#"), F.coalesce(numeric, piece))
            .otherwise(F.coalesce(F.try_element_at(table, inner), piece)))


def unescape(c: ColumnOrName) -> Column:
    """Decode numeric and named character references, once (``&amp;lt;`` gives
    ``&lt;``); texts without ``&`` are left alone."""
    col = _col(c)
    pieces = F.regexp_extract_all(col, F.lit(REFERENCE_RE), F.lit(0))
    return F.when(col.contains("&"), F.array_join(F.transform(pieces, _reference), "")).otherwise(col)


def html_to_text(c: ColumnOrName) -> Column:
    """Drop script/style/comments, replace tags by a space, decode the
    character references and collapse whitespace runs to one space."""
    col = _col(c)
    for pattern in (SCRIPT_RE, STYLE_RE, COMMENT_RE):
        col = F.regexp_replace(col, pattern, " ")
    col = unescape(F.regexp_replace(col, TAG_RE, " "))
    return F.trim(F.regexp_replace(col, SPACE_RUN_RE, " "))


# --------------------------------------------------------------------------
# Paths and names
# --------------------------------------------------------------------------

def file_ext(c: ColumnOrName) -> Column:
    """Extension by ``os.path.splitext`` rules ('' when none)."""
    return F.regexp_extract(_col(c), FILE_EXT_RE, 1)


def _fmt1(x: Column) -> Column:
    # One decimal, rounded half-even on the exact binary value (Python's
    # format semantics); format_number adds grouping commas, drop them.
    return F.replace(F.format_number(x, 1), F.lit(","), F.lit(""))


# FIXED VALUES: unit names for the two scales (kilo .. exa).
UNITS_1000 = ["B", "kB", "MB", "GB", "TB", "PB", "EB"]
UNITS_1024 = ["B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB"]


def _scaled(size: Column, base: int) -> tuple[Column, Column]:
    """Magnitude and repeatedly divided value, as the iterative loop does."""
    mag = F.lit(0)
    val = size.cast("double")
    for k in range(6, 0, -1):
        cond = size >= F.lit(base ** k)
        v = size.cast("double")
        for _ in range(k):
            v = v / F.lit(float(base))
        mag = F.when(cond & (mag == 0), F.lit(k)).otherwise(mag)
        val = F.when(cond & (mag == F.lit(k)), v).otherwise(val)
    return mag, val


def human_size(c: ColumnOrName) -> Column:
    """``"1.5KiB / 1.5kB (1500 B)"``; plain ``"n B"`` unless both the
    1000- and 1024-scales reach at least kilo."""
    size = _col(c).cast("bigint")
    m1000, v1000 = _scaled(size, 1000)
    m1024, v1024 = _scaled(size, 1024)
    u1000 = F.element_at(F.array(*[F.lit(u) for u in UNITS_1000]), m1000 + 1)
    u1024 = F.element_at(F.array(*[F.lit(u) for u in UNITS_1024]), m1024 + 1)
    plain = F.concat(size.cast("string"), F.lit(" B"))
    both = F.concat(_fmt1(v1024), u1024, F.lit(" / "), _fmt1(v1000), u1000,
                    F.lit(" ("), size.cast("string"), F.lit(" B)"))
    return F.when((m1000 > 0) & (m1024 > 0), both).otherwise(plain)


def iso_utc(epoch_seconds: ColumnOrName) -> Column:
    """Epoch seconds -> ``YYYY-MM-DDTHH:MM:SSZ`` in UTC, independent of
    the session time zone."""
    s = _col(epoch_seconds).cast("bigint")
    days = F.floor(s / F.lit(86400)).cast("int")
    secs = s - days.cast("bigint") * F.lit(86400)
    return F.format_string(
        "%sT%02d:%02d:%02dZ",
        F.date_from_unix_date(days).cast("string"),
        (secs / 3600).cast("int"), ((secs % 3600) / 60).cast("int"), secs % 60)


def epoch_seconds_ntz(ts: ColumnOrName) -> Column:
    """Whole epoch seconds of a TIMESTAMP_NTZ column (time-zone free)."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("SECOND", epoch, _col(ts).cast("timestamp_ntz"))


def name_slug(c: ColumnOrName) -> Column:
    """``'None'`` unless the name has a space; spaces become ``%20``."""
    col = _col(c)
    return F.when(col.contains(" "), F.replace(col, F.lit(" "), F.lit("%20"))) \
        .otherwise(F.lit("None"))


def basename(c: ColumnOrName) -> Column:
    """Text after the last ``/``."""
    return F.substring_index(_col(c), "/", -1)


def dirname(c: ColumnOrName) -> Column:
    """``os.path.dirname``: head up to the last ``/``, trailing slashes
    removed unless the head is only slashes."""
    head = F.regexp_extract(_col(c), r"^(.*/)", 1)
    return F.when(F.regexp_like(head, F.lit(r"^/+$")), head) \
        .otherwise(F.regexp_replace(head, r"/+$", ""))


def to_txt(c: ColumnOrName) -> Column:
    """Replace the extension (X1 rules) by ``.txt``."""
    col = _col(c)
    stem = F.substring(col, F.lit(1), F.length(col) - F.length(file_ext(col)))
    return F.concat(stem, F.lit(".txt"))


def stream_name(c: ColumnOrName) -> Column:
    """Text after the first ``:`` up to the next one; NULL without ``:``."""
    col = _col(c)
    return F.when(col.contains(":"), F.split_part(col, F.lit(":"), F.lit(2)))


def export_name(dir_col: ColumnOrName, name: ColumnOrName,
                stream: ColumnOrName | None = None) -> Column:
    """``<dir>/<basename>[.<stream>]``."""
    d = _col(dir_col)
    n = basename(name)
    if stream is not None:
        s = _col(stream)
        n = F.when(s.isNotNull() & (s != ""), F.concat(n, F.lit("."), s)).otherwise(n)
    return (F.when(d.isNull() | (d == ""), n)
            .when(d.endswith("/"), F.concat(d, n))
            .otherwise(F.concat(d, F.lit("/"), n)))


def offset_label(c: ColumnOrName) -> Column:
    """``'32256 (0x00007e00)'``."""
    col = _col(c).cast("bigint")
    return F.format_string("%d (0x%08x)", col, col)


def file_list_name(image: ColumnOrName, volume: ColumnOrName) -> Column:
    """``<image>_filelist_<volume>``."""
    return F.concat(_col(image), F.lit("_filelist_"), _col(volume).cast("string"))


def join_path(parent: ColumnOrName, name: ColumnOrName) -> Column:
    """X11: join path segments with ``/``, dropping empty segments, rooted."""
    parts = F.split(F.concat_ws("/", _col(parent), _col(name)), "/")
    return F.concat(F.lit("/"), F.array_join(F.filter(parts, lambda x: x != F.lit("")), "/"))


# --------------------------------------------------------------------------
# Catalog flags
# --------------------------------------------------------------------------

def deleted_flag(flags: ColumnOrName) -> Column:
    """Allocated bit clear -> ``'Yes'`` else ``'No'``."""
    return F.when((_col(flags).cast("bigint").bitwiseAND(1)) == 0, F.lit("Yes")) \
        .otherwise(F.lit("No"))


def is_dir(entry_type: ColumnOrName) -> Column:
    """Entry type 2 is a directory."""
    return _col(entry_type) == F.lit(2)


def fs_desc(fs_type: ColumnOrName) -> Column:
    """File-system description from its type name."""
    t = F.upper(_col(fs_type))
    return (F.when(t == "FAT12", F.lit("FAT12 file system"))
            .when(t.startswith("ISO"), F.lit("ISO file system"))
            .otherwise(F.lit("Unknown file system")))

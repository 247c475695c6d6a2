"""Text expressions: Column to Column, evaluated inside the JVM but for the title slug.

White space means the 29 characters of Python's str.isspace, which neither Java's \\s
nor its Unicode variant covers.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The white-space class, sentence-final characters and dialogue dash.
WS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SENTENCE_END = r"[!-/:-@\[-`{-~…»]\z"
DASH = "—"
CHAPTER_HEADING = r"(?iu)\A(?:chapitre [\p{L}\p{N}_]+)\z"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize(text: Column | str) -> Column:
    """White-space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(_col(text), f"{WS}+", " "))


def strip(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), rf"\A{WS}+|{WS}+\z", "")


def rstrip(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), rf"{WS}+\z", "")


def has_dialogue(raw: Column | str) -> Column:
    """Some line of the raw text opens with a dash, white space aside."""
    return _col(raw).rlike(rf"(?:\A|\n){WS}*{DASH}")


def is_chapter_heading(raw: Column | str) -> Column:
    return strip(raw).rlike(CHAPTER_HEADING)


def sentence_end(text: Column | str) -> Column:
    """The text without trailing white space, and with a period unless it is empty or ends in punctuation."""
    bare = rstrip(text)
    return F.when((bare == "") | bare.rlike(SENTENCE_END), bare).otherwise(F.concat(bare, F.lit(".")))


def passage_hash(text: Column | str) -> Column:
    return F.sha2(_col(text).cast("binary"), 256)


def chunk_hash(text: Column | str, voice: Column | str, instruct: Column | str, is_narrator: Column | str) -> Column:
    """Of everything that changes the sound; no instruct and an empty one are the same."""
    flag = F.when(_col(is_narrator), "1").otherwise("0")
    return F.sha2(F.concat_ws("\x00", _col(text), _col(voice), F.coalesce(_col(instruct), F.lit("")), flag).cast("binary"), 256)


def chunk_path(folder: Column | str, chapter: Column | str, role: Column | str, digest: Column) -> Column:
    return F.format_string("%s/chapter_%02d/chunk_%s_%s.wav", F.lit(folder) if isinstance(folder, str) else folder, _col(chapter), _col(role), digest)


def book_slug(path: Column | str) -> Column:
    """Of a book's file name: lower case, anything but a-z and 0-9 becomes an underscore."""
    name = F.regexp_extract(_col(path), r"([^/]*)\z", 1)
    stem = F.regexp_replace(name, r"\A(\.*[^.].*)\.[^.]*\z", "$1")
    slug = F.btrim(F.regexp_replace(F.lower(stem), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("book"))


def slug_of(title: str) -> str:
    """Compatibility decomposition, ASCII only, runs of anything else become an underscore."""
    ascii_only = unicodedata.normalize("NFKD", title).encode("ascii", "ignore").decode("ascii")
    return re.sub(r"[^a-zA-Z0-9]+", "_", ascii_only).strip("_").lower()


@F.pandas_udf(T.StringType())
def title_slug(titles: pd.Series) -> pd.Series:
    return titles.map(slug_of, na_action="ignore")


def chapter_filename(chapter: Column | str, title: Column | str) -> Column:
    """An empty title leaves its underscore at the end."""
    return F.format_string("chapitre_%02d_%s.wav", _col(chapter), title_slug(_col(title)))


def user_message(text: Column | str, preceding: Column | str) -> Column:
    """What an annotation provider is asked: the passage, after the line before it if there is one."""
    before = F.coalesce(_col(preceding), F.lit(""))
    both = F.concat(F.lit("Immediately preceding line (for tone/situation only):\n"), before, F.lit("\n\nPassage to annotate:\n"), _col(text))
    return F.when(before == "", _col(text)).otherwise(both)


def roster_text(roster: Column | str) -> Column:
    return F.when(F.size(_col(roster)) > 0, F.array_join(_col(roster), ", ")).otherwise("(none yet)")

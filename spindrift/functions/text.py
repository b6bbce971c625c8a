"""Text as Column expressions. Java's and DuckDB's bare \\w and \\s are ASCII, so classes are spelt out here once."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACE = r"(?U)[\s\x1c-\x1f]"
#: A run of anything but letters, digits and underscores; white space is among it.
NOT_WORD = r"[^\p{L}\p{N}_]+"
#: Sentence ends: punctuation before a capital, digit, bracket or quote; any line break.
SENTENCE = r"""(?<=[.!?])\s+(?=[A-Z0-9("'])|\n+"""


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unescape(c) -> Column:
    """HTML entities to characters, in an Arrow UDF (there is no built-in)."""

    @F.pandas_udf(StringType())
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None else html.unescape(x))

    return f(_col(c))


def normalize(c, entities: bool = False) -> Column:
    """Lower case, other signs to spaces, spaces collapsed and stripped; null stays null. ``entities`` unescapes HTML first (an Arrow UDF)."""
    x = unescape(c) if entities else _col(c)
    return F.trim(F.regexp_replace(F.lower(x), NOT_WORD, " "))


def lexical_tokens(c) -> Column:
    """Tokens of the lexical index: runs of a-z and 0-9 in the lower-cased text; null has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(_col(c)), F.lit("[a-z0-9]+"), F.lit(0)), F.array().cast("array<string>"))


def space_tokens(c) -> Column:
    """Default chunk tokens: lower-cased runs of anything but white space; null has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(_col(c)), F.lit(r"\S+"), F.lit(0)), F.array().cast("array<string>"))


class Subwords:
    """A tokenizer file of the tokenizers library as chunk tokens: ``tokens`` gives a text's pieces (no special ones), ``joined`` the decoded text of pieces.

    Word pieces and pieces with word ends decode to lower-cased, newly spaced
    text. The file must stand where the executors can read it.
    """

    def __init__(self, path: str):
        self.path = path

    def _load(self):
        from .embed import model

        def load(path):
            from tokenizers import Tokenizer

            return Tokenizer.from_file(path)

        return model(self.path, load)

    def tokens(self, c) -> Column:
        from pyspark.sql.types import ArrayType

        load = self._load

        @F.pandas_udf(ArrayType(StringType()))
        def f(s: pd.Series) -> pd.Series:
            return pd.Series([x.tokens for x in load().encode_batch([t or "" for t in s], add_special_tokens=False)], dtype=object)

        return f(_col(c))

    def joined(self, c) -> Column:
        load = self._load

        @F.pandas_udf(StringType())
        def f(s: pd.Series) -> pd.Series:
            tok = load()
            return s.map(lambda x: tok.decode([tok.token_to_id(t) for t in x], skip_special_tokens=True).strip())

        return f(_col(c))


def sentences(c) -> Column:
    """Stripped non-empty sentences; null has none."""
    parts = F.transform(F.split(F.coalesce(_col(c), F.lit("")), SENTENCE), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda x: x != "")


def assembled(*parts) -> Column:
    """Title, summary and body on lines of their own; empty and null parts dropped."""
    return F.concat_ws("\n", *[F.nullif(_col(p), F.lit("")) for p in parts])


def last_segment(c) -> Column:
    return F.substring_index(_col(c), "/", -1)


def raw_name(slug) -> Column:
    """File name of a slug's page: 80 characters, a dash, 8 of the md5."""
    s = _col(slug)
    return F.concat(F.left(s, F.lit(80)), F.lit("-"), F.left(F.md5(s), F.lit(8)), F.lit(".html"))


def topic(slug) -> Column:
    return F.split_part(_col(slug), F.lit("-"), F.lit(1))


# Slug prefixes of subtypes, audience markers, page chrome, the refusal.
BULLETIN_PREFIX = "letters-and-medicine-recalls"
ROUNDUP_PREFIXES = ("covid-19", "safety-roundup")
ROUNDUP_PART = "medsafetyweek"
HCP_MARKER = "advice for healthcare professionals"
PATIENT_PATTERN = "advice[^.]{0,40}patient|give to patients|for patients and caregivers|advice for patients"
BOILERPLATE = (
    "cookies on gov.uk",
    "is this page useful",
    "skip to main content",
    "tell us whether you accept cookies",
    "hide this message",
    "your browser does not",
    "related content",
    "is this page useful?",
)
REFUSAL = "I can't answer that from the provided MHRA sources. The retrieved context does not contain supporting information."
REFUSAL_SIGN = "i can t answer that from the provided mhra sources the retri"


def subtype(slug) -> Column:
    s = _col(slug)
    round_up = s.contains(ROUNDUP_PART)
    for p in ROUNDUP_PREFIXES:
        round_up = round_up | s.startswith(p)
    return F.when(s.startswith(BULLETIN_PREFIX), "bulletin").when(round_up, "roundup").otherwise("standalone")


def register(text) -> Column:
    t = F.lower(_col(text))
    hcp, patient = F.coalesce(t.contains(HCP_MARKER), F.lit(False)), F.coalesce(t.rlike(PATIENT_PATTERN), F.lit(False))
    return F.when(hcp & patient, "HCP+patient").when(hcp, "HCP").when(patient, "patient").otherwise("general")


def boilerplate_found(text) -> Column:
    """Markers of page chrome that a text holds."""
    t = F.lower(F.coalesce(_col(text), F.lit("")))
    return F.filter(F.array(*[F.lit(m) for m in BOILERPLATE]), lambda m: F.contains(t, m))


def is_refusal(answer) -> Column:
    return F.coalesce(normalize(answer).contains(REFUSAL_SIGN), F.lit(False))


def dot(a, b) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v) -> Column:
    """A vector at length 1 in double precision; zero vectors stay."""
    n = F.sqrt(dot(v, v))
    return F.transform(_col(v), lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row: lambdas would evaluate an outer expression once an element."""
    return F.element_at(F.transform(F.array(value), body), 1)

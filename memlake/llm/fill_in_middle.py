"""Fill-in-the-middle transformation of texts in an Arrow-batched pandas UDF.

A text is cut into units, matches of a pattern from left to right.  The regex
library's ``finditer`` runs over them a block of units at a time; where each unit
ends is kept in an array of four bytes an entry, so that two lookups give the cuts
between prefix, middle and suffix.  All draws come from a digest of the document's
id, so a rerun gives the same forms and cuts.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.session import fresh

#: One code point, whatever it is.
CODE_POINT = r"(?s:.)"
#: Units that one match of the pattern takes at most; the next match goes on from there.
UNITS_PER_MATCH = 256


class Markers(NamedTuple):
    """What stands before prefix, suffix and middle; each begins with a character that none has elsewhere."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


def unit_ends(unit: str) -> Callable[[str], array]:
    """A function that gives the end offsets of a text's units; a unit is a match that isn't empty."""
    pattern = regex.compile(rf"(?:(?P<one_unit>(?>{unit}))){{1,{UNITS_PER_MATCH}}}")
    if pattern.match(""):
        raise ValueError("a unit may not be empty")

    def ends(text: str) -> array:
        out = array("I")
        for match in pattern.finditer(text):
            out.extend(match.ends("one_unit"))
        return out

    return ends


def draws(doc_id: object, seed: int = 1) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits from the digest of seed and id; a null id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))


def restore(output: str, form: str, markers: Markers = Markers()) -> str:
    """The text that an output was made of."""
    if form == "plain":
        return output
    first, second = (markers.prefix, markers.suffix) if form == "psm" else (markers.suffix, markers.prefix)
    head, _, middle = output.removeprefix(first).partition(markers.middle)
    one, _, two = head.partition(second)
    return one + middle + two if form == "psm" else two + middle + one


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


_RESULT = "n long, form string, prefix string, middle string, suffix string, output string, output_sha256 string, restored_sha256 string"


def _transformed(unit: str, seed: int, plain: int, spm: int, markers: Markers):
    ends_of = unit_ends(unit)

    def one(doc_id: object, text: str) -> tuple:
        ends = ends_of(text)
        n = len(ends)
        h1, h2, h3, h4 = draws(doc_id, seed)
        if not text or h3 % 100 >= 100 - plain or any(m in text for m in markers):
            digest = _sha256(text)
            return n, "plain", None, None, None, text, digest, digest
        cuts = sorted((h1 % (n + 1), h2 % (n + 1)))
        lo, hi = (ends[k - 1] if k else 0 for k in cuts)
        prefix, middle, suffix = text[:lo], text[lo:hi], text[hi:]
        if h4 % 100 < spm:
            form, output = "spm", f"{markers.suffix}{suffix}{markers.prefix}{prefix}{markers.middle}{middle}"
        else:
            form, output = "psm", f"{markers.prefix}{prefix}{markers.suffix}{suffix}{markers.middle}{middle}"
        return n, form, prefix, middle, suffix, output, _sha256(output), _sha256(restore(output, form, markers))

    @F.pandas_udf(_RESULT)
    def transformed(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = [one(i, "" if t is None else t) for i, t in zip(ids, texts, strict=True)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _RESULT.split(", ")])

    return transformed


def fill_in_middle(
    documents: DataFrame,
    unit: str = CODE_POINT,
    seed: int = 1,
    plain: int = 10,
    spm: int = 20,
    markers: Markers = Markers(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, n, form, prefix, middle, suffix, output, output_sha256, restored_sha256`` for each row.

    The prefix has the smaller and prefix and middle the larger of two drawn numbers
    of units, 0 to all ``n``; what follows the last whole unit goes with the suffix.
    Forms: ``psm`` is prefix, suffix, middle, each behind its marker; ``spm``, for
    ``spm`` of 100 documents, suffix, prefix, middle; ``plain``, for ``plain`` of 100
    and for texts that are empty or contain a marker, the text as it is, its parts
    null.  ``restored_sha256`` is the digest of what ``restore`` makes of output and
    form.  Null texts count as empty, null ids as an empty id.  Draws depend on the
    id alone: rows that repeat an id and a text get the same result each, and rows of
    one id with different texts the same draws.  Texts of any length are read whole,
    in four bytes a unit beside the text.  An empty table gives an empty one.  Other
    columns are ignored, whatever their names.
    """
    text = F.col(text_col).cast("string")
    made = fresh(documents, "made")
    out = documents.select(F.col(id_col).cast("long").alias("doc_id"), _transformed(unit, seed, plain, spm, markers)(F.col(id_col).cast("string"), text).alias(made))
    return out.select("doc_id", *[F.col(f"{made}.{c.split()[0]}") for c in _RESULT.split(", ")])

"""Text expressions: tokens, folding, snippets, secrets, key tokens."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F



def _marks() -> tuple[str, str]:
    """Letters with marks and their plain ones, by Unicode's decomposition, then the marks themselves, which have no counterpart and go."""
    letters, plain, marks = [], [], []
    for code in range(0x80, 0x20000):
        letter = chr(code)
        if unicodedata.category(letter)[0] == "M":
            marks.append(letter)
        elif not 0xAC00 <= code <= 0xD7A3:
            base = "".join(c for c in unicodedata.normalize("NFD", letter) if unicodedata.category(c)[0] != "M")
            if len(base) == 1 and base != letter:
                letters.append(letter)
                plain.append(base)
    return "".join(letters + marks), "".join(plain)


#: What folding replaces and by what; letters without a decomposition, as ł and ø, stay.
ACCENTED, PLAIN = _marks()
# The ASCII alphabets.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

# Phrases of which one in a turn makes an identity record.
IDENTITY_SIGNALS = (
    "feeling like", "imposter", "impostor", "barely know", "don't know my own",
    "don't even know how", "want them to feel", "i'm proud", "i feel like a", "i don't know how to",
)


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(text: Column | str) -> Column:
    """Lower case without accents: a letter and its marks, as one code point or several, become the plain letter."""
    return F.translate(F.lower(column(text)), ACCENTED, PLAIN)


def ascii_lower(text: Column | str) -> Column:
    """A-Z folded, all other letters as they are."""
    return F.translate(column(text), UPPER, LOWER)


def tokens(text: Column | str) -> Column:
    """Runs of letters and digits, folded; null counts as empty."""
    return F.regexp_extract_all(fold(F.coalesce(column(text), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def single_line(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(column(text), r"\s+", " "))


def truncate(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, a cut marked by an ellipsis."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, max(0, limit - 1))), F.lit("…")))


def snippet(text: Column | str, terms: Sequence[str], width: int) -> Column:
    """A window of ``width`` characters around the earliest term, cuts marked by ellipses."""
    flat = single_line(text)
    low = F.lower(flat)
    hits = [F.nullif(F.locate(t, low), F.lit(0)) for t in terms]
    hit = F.least(*hits, F.lit(None).cast("int")) if len(hits) > 1 else (hits[0] if hits else F.lit(None).cast("int"))
    size = F.length(flat)
    begin = F.greatest(F.lit(0), F.least(hit - 1 - width // 3, F.greatest(F.lit(0), size - width)))
    window = F.trim(F.substring(flat, begin + 1, F.lit(width)))
    marked = F.concat(F.when(begin > 0, F.lit("…")).otherwise(""), window, F.when(begin + width < size, F.lit("…")).otherwise(""))
    return F.when(hit.isNull() | (size <= width), truncate(flat, width)).otherwise(marked)


# Formats of credentials, taken out whole with their label.
SECRET_FORMATS = (
    r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----[\s\S]*?-----END (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    r"(?i)\b(?:api[_-]?key|secret|token)\s*[:=]\s*['\"]?[A-Za-z0-9_./+=-]{16,}",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\b(?:ghp|gho|ghu|ghs|github_pat)_[A-Za-z0-9_]{20,}\b",
    r"\bsk-[A-Za-z0-9_-]{20,}\b",
)
LONG_TOKEN, LEAST_ENTROPY = r"[A-Za-z0-9_+/=-]{32,}", 4.0


def entropy(token: Column) -> Column:
    """Shannon entropy in bits a character."""
    share = lambda c: (F.length(token) - F.length(F.replace(token, c, F.lit("")))) / F.length(token)
    return -F.aggregate(F.array_distinct(F.filter(F.split(token, ""), lambda c: c != "")), F.lit(0.0), lambda s, c: s + share(c) * F.log2(share(c)))


def redact(text: Column | str, mark: str = "[REDACTED]") -> Column:
    """Keys, labelled secrets and long tokens of high entropy replaced, each by one mark.

    Wider spans go first, so what lies in them isn't marked again.
    """
    out = column(text)
    for pattern in SECRET_FORMATS:
        out = F.regexp_replace(out, pattern, mark)
    random = F.filter(F.array_distinct(F.regexp_extract_all(out, F.lit(LONG_TOKEN), F.lit(0))), lambda t: entropy(t) >= LEAST_ENTROPY)
    longest_first = F.transform(F.sort_array(F.transform(random, lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))), asc=False), lambda e: e["t"])
    return F.aggregate(longest_first, out, lambda s, t: F.replace(s, t, F.lit(mark)))


def has_identity_signal(text: Column | str) -> Column:
    low = F.lower(column(text))
    found = F.lit(False)
    for phrase in IDENTITY_SIGNALS:
        found = found | F.contains(low, F.lit(phrase))
    return found


# Fixed value: what counts as one token of an identifier, a name or a number; signs join it only inside.
KEY_TOKEN = r"[A-Za-z0-9][A-Za-z0-9_@-]*(?:[./:][A-Za-z0-9][A-Za-z0-9_@-]*)*"


def key_tokens(text: Column | str, folded: bool = False) -> Column:
    """Distinct tokens with a digit or a capital, in order; ``folded`` compares them without case."""
    found = F.filter(F.regexp_extract_all(column(text), F.lit(KEY_TOKEN), F.lit(0)), lambda t: F.regexp_like(t, F.lit("[0-9A-Z]")))
    return F.array_distinct(F.transform(found, F.lower) if folded else found)


# Fixed value: words that announce an end date.
END_WORDS = r"(?:until|through|thru|valid until|expires?(?: on)?|no later than)"


def end_date(text: Column | str) -> Column:
    """The date written after until, through, expires and the like; null without one, or if it is none."""
    found = F.regexp_extract(column(text), rf"(?i)\b{END_WORDS}\s+(\d{{4}}-\d{{2}}-\d{{2}}|\d{{4}}/\d{{2}}/\d{{2}}|[A-Z][a-z]+ \d{{1,2}},? \d{{4}})", 1)
    plain = F.initcap(F.translate(F.translate(found, "/", "-"), ",", ""))
    tries = [F.try_to_timestamp(plain, F.lit(f)) for f in ("yyyy-MM-dd", "MMMM d yyyy", "MMM d yyyy")]
    return F.coalesce(*tries).cast("date")


def similarity(a: Column, b: Column) -> Column:
    """1 for equal names; by prefix, containment, or edit distance, scaled by the ratio of lengths."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    ratio = short / long
    return (
        F.when(a == b, F.lit(1.0))
        .when(F.startswith(a, b) | F.startswith(b, a), 0.7 + 0.3 * ratio)
        .when(F.contains(a, b) | F.contains(b, a), 0.5 + 0.3 * ratio)
        .otherwise(1 - F.levenshtein(a, b) / long)
    )


def one_edit(a: Column, b: Column) -> Column:
    """Equal, or one insertion, deletion, change or swap of neighbours apart.

    Unequal words need two letters each, at most 512, and the same first two; only
    words of one length may have these two swapped.
    """
    n = F.length(a)
    differ = F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    first = F.try_element_at(differ, F.lit(1))
    swapped = (
        (F.length(b) == n)
        & (F.size(differ) == 2)
        & (F.try_element_at(differ, F.lit(2)) == first + 1)
        & (F.substring(a, first, F.lit(1)) == F.substring(b, first + 1, F.lit(1)))
        & (F.substring(a, first + 1, F.lit(1)) == F.substring(b, first, F.lit(1)))
    )
    head_a, head_b = F.substring(a, 1, 2), F.substring(b, 1, 2)
    heads = (head_a == head_b) | ((F.length(b) == n) & (head_a == F.reverse(head_b)))
    near = (n >= 2) & (F.length(b) >= 2) & (n <= 512) & (F.length(b) <= 512) & heads & ((F.levenshtein(a, b) <= 1) | F.coalesce(swapped, F.lit(False)))
    return (a == b) | near


def one_edit_keys(name: Column) -> Column:
    """Hashes of a name and of itself less each of its letters, with its first two letters in order.

    Names that ``one_edit`` calls near share a key: both less the letter that was
    put in, left out, changed or swapped are equal, and so are the two letters.
    """
    head = F.array_join(F.array_sort(F.split(F.substring(name, 1, 2), "")), "")
    less = F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.xxhash64(head, F.concat(F.substring(name, F.lit(1), i - 1), F.substring(name, i + 1, F.length(name)))))
    return F.array_distinct(F.concat(F.array(F.xxhash64(head, name)), F.when((F.length(name) >= 2) & (F.length(name) <= 512), less).otherwise(F.expr("cast(array() as array<bigint>)"))))

"""Personal data by anchor expansion.

One Aho-Corasick pass over a whole text finds at-signs, plus signs, digits, schemes and identifier cues. From each anchor
a deterministic local parser expands to the boundaries and validates; each parser moves forward only, so a text takes
linear time. Kinds: email, ip, card, phone as in the base patterns, each leftmost and non-overlapping within its kind;
then url (a scheme and what follows) and account, which are added where they touch no base span. An account follows a cue
word, in any case: a bank number with its country and check digits (blanks or hyphens between groups, remainder 1 modulo
97); a social security number of three valid groups; another account or passport number of 6 to 34 letters and digits,
digits for the greater part; after a password's or key's cue, and only behind ``:`` or ``=``, six characters or more with
a digit.

Defined cases: null and empty texts have no spans; very long texts are read whole; of spans of one kind that overlap the
first stays, and of kinds that meet at one place ``redact`` names the longest; repeated rows are rows each; offsets are
code points, end exclusive; no rows give no rows. ``redact`` keeps every other column.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, slices, tidied

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
SCHEMES = ("http", "https", "ftp", "ssh")
CUES = {
    "bank": ("iban",),
    "social": ("ssn", "social security"),
    "number": ("account", "acct", "konto", "kontonummer", "compte", "cuenta", "passport", "pass-nr", "reisepass"),
    "secret": ("password", "passwd", "passwort", "token", "userid", "user id", "api_key", "api-key", "api key", "apikey", "secret", "secret_key", "access_key"),
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_DIGITS = re.compile(r"[0-9]+")
_DOTTED = re.compile(r"[0-9.]*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"[A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=%-]+")
_LINK = re.compile(r"[ \t_-]*(?:(?:number|nummer|num|no|nr|id)\b\.?[ \t]*)?(?:is\b)?[ \t]*[\"']?[:=#]?[ \t]*[\"']?", re.I)
_SET = re.compile(r"[\"']?[ \t]*[:=][ \t]*[\"']?([^\s\"',;]{6,})")
_BANK = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:[ -]?[A-Za-z0-9]){11,30}")
_SOCIAL = re.compile(r"(?!000|666|9)[0-9]{3}([ -]?)(?!00)[0-9]{2}\1(?!0000)[0-9]{4}(?![A-Za-z0-9])")
_NUMBER = re.compile(r"[A-Za-z0-9](?:[ .-]?[A-Za-z0-9])+")
_FOLD = {c: c + 32 for c in range(65, 91)}


def folded(text: str) -> str:
    """Lower case of the same length, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_FOLD)



def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, ("d", 1))
    a.add_word("@", ("@", 1))
    a.add_word("+", ("+", 1))
    a.add_word("://", ("u", 3))
    for kind, words in CUES.items():
        for cue in words:
            a.add_word(cue, (kind, len(cue)))
    a.make_automaton()
    return a


def bank_end(text: str, at: int) -> int | None:
    """Where a bank number that begins here ends: its longest form of 15 to 34 characters that passes its check."""
    m = _BANK.match(text, at)
    if not m:
        return None
    end = m.end()
    while end - at >= 15:
        plain = re.sub("[ -]", "", text[at:end]).upper()
        whole = end == len(text) or not text[end].isalnum()
        if whole and 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
            return end
        end -= 1
        while text[end - 1] in " -":
            end -= 1
    return None


def account_after(text: str, at: int, kind: str) -> tuple[int, int] | None:
    """The identifier that follows a cue which ends here."""
    if kind == "secret":
        m = _SET.match(text, at)
        return m.span(1) if m and any(c.isdigit() for c in m[1]) else None
    s = _LINK.match(text, at).end()
    if (end := bank_end(text, s)) is not None:
        return s, end
    if kind == "social":
        m = _SOCIAL.match(text, s)
        return m.span() if m else None
    if kind == "number" and (m := _NUMBER.match(text, s)):
        # groups as long as they have digits
        end = s
        for g in re.finditer(r"[ .-]?[A-Za-z0-9]+", m[0]):
            if not any(c.isdigit() for c in g[0]):
                break
            end = s + g.end()
        plain = re.sub(r"[ .-]", "", text[s:end])
        if 6 <= len(plain) <= 34 and 2 * sum(c.isdigit() for c in plain) > len(plain):
            return s, end
    return None


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if k % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


def spans_of(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(kind by its number, start, end) of a whole text, by kind and start."""
    found: list[list[tuple[int, int]]] = [[] for _ in KINDS]
    extra: list[tuple[int, int, int]] = []
    email_end, last_at, ip_end, card_end = 0, -1, 0, 0
    url_end = 0
    n = len(text)
    for end, (what, size) in automaton.iter(folded(text)):
        p = end - size + 1
        if what == "d":
            if p >= ip_end:
                stop = _DOTTED.match(text, p).end()
                groups = [m.span() for m in _DIGITS.finditer(text, p, stop)]
                k = 0
                while k + 3 < len(groups):
                    four = groups[k : k + 4]
                    gap = next((x for x in range(3) if four[x + 1][0] != four[x][1] + 1), None)
                    if gap is not None:
                        k += gap + 1
                        continue
                    if all(len(text[a:b].lstrip("0")) <= 3 and int(text[a:b][-3:]) <= 255 for a, b in four):
                        found[1].append((four[0][0], four[3][1]))
                    k += 4
                ip_end = stop
            if p >= card_end:
                m = _CARD.match(text, p)
                card_end = m.end() if m else p + 1
                if m:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        found[2].append(m.span())
        elif what == "@":
            low = max(email_end, last_at + 1)
            s = p
            while s > low and text[s - 1] in _LOCAL:
                s -= 1
            last_at = p
            if s < p and (m := _DOMAIN.match(text, p + 1)):
                found[0].append((s, m.end()))
                email_end = m.end()
        elif what == "+":
            m = _PHONE.match(text, p)
            if m and 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                found[3].append(m.span())
        elif what == "u" and p >= url_end:
            s = next((p - len(x) for x in SCHEMES if text[max(0, p - len(x)) : p].lower() == x and not (p > len(x) and text[p - len(x) - 1].isalnum())), None)
            if s is not None and (m := _URL.match(text, p + 3)):
                url_end = m.start() + len(m[0].rstrip(".,;:!?)'"))
                if url_end > p + 3:
                    extra.append((4, s, url_end))
        elif what in CUES and (p == 0 or not text[p - 1].isalnum()) and (end + 1 < n and not text[end + 1].isalnum()):
            if (found_at := account_after(text, end + 1, what)) is not None:
                extra.append((5, *found_at))
    taken = sorted(x for kind in found for x in kind)
    starts = [x[0] for x in taken]
    reach, most = [], 0
    for _, e in taken:
        most = max(most, e)
        reach.append(most)
    for kind, s, e in sorted(extra):
        k = bisect_left(starts, e)
        if (k == 0 or reach[k - 1] <= s) and not (found[kind] and found[kind][-1][1] > s):
            found[kind].append((s, e))
    return [(k, s, e) for k, own in enumerate(found) for s, e in own]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_SPAN_SQL = "array<struct<kind:string,start:bigint,end:bigint>>"


@tidied
def _find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = _automaton()
    for batch in slices(batches):
        texts = batch.column(batch.num_columns - 1).to_pylist()
        spans = [[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in spans_of(t, automaton)] if t else [] for t in texts]
        yield pa.record_batch([*batch.columns[:-1], pa.array(spans, pa.list_(_SPAN))], names=[*batch.schema.names[:-1], "spans"])


def find_pii(docs: DataFrame) -> DataFrame:
    """Rows doc_id, spans (kind, start, end by kind, then start); one per row of docs."""
    return docs.select("doc_id", "text").mapInArrow(_find, T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))]))


def _redact(at: int) -> callable:
    @tidied
    def redact(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in slices(batches):
            out = []
            for t in batch.column(at).to_pylist():
                parts, done = [], 0
                for k, s, e in sorted(spans_of(t, automaton), key=lambda x: (x[1], -x[2])) if t else ():
                    if s >= done:
                        parts += [t[done:s], f"<{KINDS[k].upper()}>"]
                    elif e <= done:
                        continue
                    done = max(done, e)
                out.append(t if t is None or not parts else "".join([*parts, t[done:]]))
            yield pa.record_batch([*batch.columns[:at], pa.array(out, pa.string()), *batch.columns[at + 1 :]], names=batch.schema.names)

    return redact


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns, each span of a text replaced by its kind; overlapping spans by the first one's."""
    return docs.mapInArrow(_redact(docs.columns.index("text")), docs.schema)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: counts, digest of the base spans, and all spans."""
    found = find_pii(documents(spark, sf_dir))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[n(k) for k in BASE], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


QUERIES = {"op7_pii": op7_pii}
ORACLE_SQL: dict[str, str] = {}

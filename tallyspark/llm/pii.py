"""Personal data (6): anchors found by Aho-Corasick, expanded and validated by local parsers.

One pass of an Aho-Corasick automaton over the text in lower case finds at-signs, plus signs, URL schemes,
identifier cues, prefixes of known secrets, and pairs of digits (side by side, or with a dot, a blank or a hyphen
between them); each anchor has a parser that expands it to the left and right and validates what it got.
All parsers together are linear in the text, whatever it repeats (what a parser has read in vain is not read again), and
none has a limit to the length of what it finds. Kinds in their order: email, ip, card, phone (the base kinds), then those that the method adds:
address (URLs), account (numbers and words with digits after a cue, also behind ``is`` or ``number``; IBANs with or
without one) and secret (keys and tokens of a known shape, PEM blocks, what stands behind ``password`` and its like after a
colon or an equals sign, unless it is a bare word of prose).

Edge cases: null and empty texts have no spans (``base_sha256`` is that of the empty string, ``spans`` is
empty); spans are in code points, end exclusive; repeated rows each get a row; extra columns are passed
over; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "address", "account", "secret")
NUMBERS = (*(f"n_{k}" for k in KINDS), "n_spans")
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "sftp://")
#: Words that announce an account number, and those that announce a secret.
CUES = (
    "account", "acct", "konto", "cuenta", "compte", "iban", "passport", "reisepass", "pasaporte", "passeport", "ssn", "customer",
    "kunde", "cliente", "client", "user id", "userid", "card number",
)
SECRET_CUES = (
    "token", "secret", "password", "passwd", "passwort", "api key", "api_key", "api-key", "apikey", "access key", "access_key",
    "private key",
)
#: How secrets of known shape begin, and all of their form.
SHAPES = {
    "akia": r"AKIA[0-9A-Z]{16}", "asia": r"ASIA[0-9A-Z]{16}", "aiza": r"AIza[0-9A-Za-z_-]{35}", "ghp_": r"ghp_[0-9A-Za-z]{36}", "gho_": r"gho_[0-9A-Za-z]{36}",
    "ghs_": r"ghs_[0-9A-Za-z]{36}", "github_pat_": r"github_pat_[0-9A-Za-z_]{22,}+", "glpat-": r"glpat-[0-9A-Za-z_-]{20,}+", "sk_live_": r"sk_live_[0-9A-Za-z]{16,}+",
    "xoxb-": r"xoxb-[0-9A-Za-z-]{10,}+", "xoxp-": r"xoxp-[0-9A-Za-z-]{10,}+", "eyj": r"eyJ[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+",
    "-----begin ": r"-----BEGIN [A-Z0-9 ]*+-----(?:[^-]++-----END [A-Z0-9 ]*+-----)?",
}
FORMS = {k: re.compile(f"{v}(?![0-9A-Za-z])") for k, v in SHAPES.items()}
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*")
RUN = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
HOST = re.compile(r"(?:[^\s/?#<>\"'@]++@)?(?:\[[0-9A-Fa-f:.]+\]|[^\W_][\w-]*+(?:\.[\w-]++)*)(?::[0-9]{1,5})?(?:[/?#][^\s<>\"']*)?")
#: Words that stand between a cue and its number.
CUE = (
    r"(?:[ \t]{0,4}(?:no|nr|num|number|id|code|nummer|numero|número|numéro)\b\.?)?(?:[ \t]{1,4}(?:is|was|are|ist|lautet|es|est)\b)?"
    r"[ \t]{0,4}[:=#]?[ \t]{0,4}[\"']?"
)
IBAN = r"[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
WORD = re.compile("[A-Za-z0-9-]+")
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27,
    "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25,
    "RO": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}
IBAN_FORMS = {k: re.compile(rf"{k}[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for k, n in IBAN_LENGTHS.items()}
#: A day written in eight digits is no account.
DAY = re.compile(r"(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])")
#: What secrets of known shape are made of.
TOKEN = re.compile(r"[0-9A-Za-z_.-]*+")
AFTER_CUE = re.compile(rf"{CUE}(?:({IBAN})|([A-Za-z0-9][A-Za-z0-9-]*+))")
#: Behind a secret's cue: anything quoted or not after a colon or an equals sign, else a long word with a digit.
AFTER_SECRET = re.compile(r"[ \t]{0,4}[\"']?[ \t]{0,4}[:=][ \t]{0,4}[\"']?([^\s\"'<>,;]{6,}+)|[ \t]{1,4}([A-Za-z0-9_+/.-]{16,}+)", re.A)


def automaton() -> ahocorasick.Automaton:
    digits = "0123456789"
    words = [("@", "email"), ("+", "phone"), *((s, "address") for s in SCHEMES), *((c, "account") for c in CUES)]
    words += [*((c, "cue") for c in SECRET_CUES), *((c, "secret") for c in SHAPES)]
    words += [(a + between + b, "card") for between in ("", " ", "-") for a in digits for b in digits]
    words += [(f"{a}.{b}", "ip") for a in digits for b in digits]
    words += [(chr(a) + b, "iban") for a in range(97, 123) for b in digits]
    found = ahocorasick.Automaton()
    for word, what in words:
        found.add_word(word, (what, word))
    found.make_automaton()
    return found


def lower(text: str) -> str:
    """Lower case in which every character keeps its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(x := c.lower()) > 1 else x for c in text)


def luhn(digits: str) -> bool:
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def iban(text: str) -> bool:
    t = text.replace(" ", "")
    return 15 <= len(t) <= 34 and t[:2].isalpha() and t[2:4].isdigit() and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def _email(text: str, at: int, low: int) -> tuple[int, int] | None:
    start = at
    while start > low and text[start - 1] in LOCAL:
        start -= 1
    m = DOMAIN.match(text, at + 1) if start < at else None
    return (start, m.end()) if m else None


def _account(text: str, cue: int, end: int) -> tuple[tuple[int, int] | None, int]:
    """The account behind a cue, and how far was read: a word that is none holds none either."""
    if cue and text[cue - 1].isalnum():
        return None, end
    m = AFTER_CUE.match(text, end)
    if m is None:
        return None, end
    if m[1] and iban(m[1]):
        return m.span(1), m.end(1)
    word = WORD.match(text, m.start(m.lastindex))
    good = sum(c.isdigit() for c in word[0]) >= 4 and len(word[0]) >= 6 and not DAY.fullmatch(word[0])
    return word.span() if good else None, word.end()


def _iban(text: str, at: int) -> tuple[int, int] | None:
    """An IBAN whose second letter stands at ``at``: it needs no cue, as its country's length and check digits tell it."""
    form = at and not (at > 1 and text[at - 2].isalnum()) and IBAN_FORMS.get(text[at - 1 : at + 1])
    m = form.match(text, at - 1) if form else None
    return m.span() if m and iban(m[0]) else None


def _secret(text: str, cue: int, end: int) -> tuple[int, int] | None:
    if cue and text[cue - 1].isalnum():
        return None
    m = AFTER_SECRET.match(text, end)
    if m is None or (m[2] and not any(map(str.isdigit, m[2]))):
        return None
    a, b = m.span(m.lastindex)
    b = a + len(text[a:b].rstrip(".!?)]}"))
    prose = m[1] and text[a:b].isalpha() and text[a - 1] not in "\"'" and "=" not in text[end:a]
    return None if prose else (a, b)


def _ips(text: str, at: int, low: int) -> tuple[list[tuple[int, int]], int]:
    """The addresses in a run of digits and dots around a place, and where the run ends."""
    while at > low and "0" <= text[at - 1] <= "9":
        at -= 1
    m, out = DOTTED.match(text, at), []
    parts = m[0].split(".")
    for k in range(0, len(parts) - 3, 4):
        four = parts[k : k + 4]
        end = at + sum(map(len, four)) + 3
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
            out.append((at, end))
        at = end + 1
    return out, m.end()


def spans(text: str, anchors: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind, in order of their start; none overlap within a kind."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    over = dict.fromkeys(KINDS, 0)  # how far each kind has read
    vain: dict[str, int] = {}  # how far a secret's form was read and not found, by how it begins
    for last, (what, word) in anchors.iter(lower(text)):
        at, end = last - len(word) + 1, last + 1
        kind = {"cue": "secret", "iban": "account"}.get(what, what)
        if at < over[kind] or at < vain.get(word, 0):
            continue
        got = None
        if what == "email":
            got = _email(text, at, over[kind])
        elif what == "phone":
            if m := PHONE.match(text, at):
                over[kind] = m.end()
                got = m.span() if 9 <= sum(c.isdigit() for c in m[0]) <= 15 else None
        elif what == "card":
            m = RUN.match(text, at)
            over[kind] = m.end()
            digits = m[0].replace(" ", "").replace("-", "")
            got = m.span() if 13 <= len(digits) <= 19 and luhn(digits) else None
        elif what == "ip":
            found, over[kind] = _ips(text, at, over[kind])
            out[kind] += found
        elif what == "address":
            m = HOST.match(text, end)
            got = m and (at, end + len(m[0].rstrip(".,;:!?)]}")))
        elif what == "secret":
            m = FORMS[word].match(text, at) if not (at and text[at - 1].isalnum()) else None
            got = m and m.span()
            if m is None and word in ("eyj", "xoxb-", "xoxp-", "glpat-"):
                vain[word] = max(end, TOKEN.match(text, at).end()) if not (at and text[at - 1].isalnum()) else end
        elif what == "account":
            got, read = _account(text, at, end)
            over[kind] = max(over[kind], read) if got is None else over[kind]
        else:
            got = _iban(text, at) if what == "iban" else _secret(text, at, end)
        if got and got[0] >= over[kind] or got and kind in ("phone", "card"):
            out[kind].append(got)
            over[kind] = got[1]
    return out


def joined(found: dict[str, list[tuple[int, int]]], kinds) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, n_address, n_account, n_secret, n_spans, base_sha256, spans of each document."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            found = [spans(t.as_py() or "", anchors) for t in batch.column(1)]
            counts = [pa.array([len(f[k]) for f in found], pa.int64()) for k in KINDS]
            counts.append(pa.array([sum(map(len, f.values())) for f in found], pa.int64()))
            digests = [hashlib.sha256(joined(f, BASE).encode()).hexdigest() for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(digests, pa.string()), pa.array([joined(f, KINDS) for f in found], pa.string())],
                ["id", *NUMBERS, "base_sha256", "spans"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(
        scan, f"id {kind}, {', '.join(f'{n} long' for n in NUMBERS)}, base_sha256 string, spans string",
    ).withColumnRenamed("id", id_col)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))

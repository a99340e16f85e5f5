"""Personal data: exact base patterns, and boosted trees over high-recall candidates.

Base spans are what four patterns with their checks accept.  Generators propose more,
overlapping spans in other formats; gradient-boosted trees judge each by its format and
context, a calibrated probability and a threshold a kind select those that are added.
The trees are trained here, on generated texts with known spans and look-alikes.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.llm.common import bound_batches, column, slices, table
from buildlens.llm.gbt import Tree, boost
from buildlens.llm.textops import utf8

KINDS = ["email", "ip", "card", "phone", "secret", "iban", "ssn"]
BASE = KINDS[:4]
Span = tuple[int, int, str]  # start, end, kind

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each base kind that pass its check, by start, then kind.

    Written so that no text costs more than a few passes, long runs of one class included.
    """
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at)):
            out.append((begin, m.end(), "email"))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        parts, begin = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = begin + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                out.append((begin, end, "ip"))
            begin = end + 1
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() and 14 <= len(d := only_digits(m[0])) <= 19 and luhn(d):
            out.append((*m.span(), "card"))
    for m in _PHONE.finditer(text):
        if 10 <= len(only_digits(m[0])) <= 15:
            out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


#: Generators of further candidates; quantifiers are bounded or possessive, and tokens run to their ends.
_GENERATORS = [
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}+(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]{2,63}+){1,4}")),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}:?[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[ .-]?[0-9]{4}){2}[ .-]?[0-9]{1,7}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+])(?:00[ ]?[1-9][0-9]?[ ]?)?\(?[0-9]{2,4}\)?[ ./-][0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])")),
    ("secret", re.compile(r"(?<![A-Za-z0-9])A[KS]IA[0-9A-Z]{16}(?![A-Za-z0-9])")),
    ("secret", re.compile(r"(?<![A-Za-z0-9])(?:gh[pousr]_|sk-|xox[abp]-)[A-Za-z0-9_-]{16,}+")),
    ("secret", re.compile(r"""(?<![A-Za-z0-9])(?:password|passwd|pwd|token|secret|api[_-]?key)["']? ?[:=] ?["']?([A-Za-z0-9+/_.!@#$%^&*-]{6,}+)""", re.I)),
    ("secret", re.compile(r"(?<![A-Za-z0-9])[0-9a-f]{32,}+(?![A-Za-z0-9])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])")),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9-])")),
]


def candidates(text: str, taken: list[Span]) -> list[Span]:
    """Proposed spans that touch no base span; they may overlap each other."""
    out = set()
    for kind, pattern in _GENERATORS:
        for m in pattern.finditer(text):
            span = m.span(1) if m.re.groups and m[1] else m.span()
            out.add((*span, kind))
    if taken:
        found = sorted(out)
        ends = np.maximum.accumulate([t[1] for t in taken])
        at = np.searchsorted([t[0] for t in taken], [c[1] for c in found])
        out = {c for c, k in zip(found, at) if k == 0 or ends[k - 1] <= c[0]}
    return sorted(out, key=lambda s: (s[0], s[1], KINDS.index(s[2])))


#: Words near a span that speak for a kind, or for a look-alike.
_CUES = {
    "email": ("mail", "contact", "write", "reach"),
    "ip": ("host", "server", "address", "login", "ipv6"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "pay"),
    "phone": ("phone", "call", "tel", "fax", "mobile", "whatsapp"),
    "secret": ("password", "token", "secret", "key", "login", "credential"),
    "iban": ("iban", "account", "bank", "transfer"),
    "ssn": ("ssn", "social", "security", "insurance"),
    "other": ("version", "page", "isbn", "order", "invoice", "date", "commit", "sha", "serial", "build", "hash", "md5", "checksum", "ratio", "score", "figure"),
}
_AROUND = 32
_KEY_STARTS = ("sk-", "xoxa-", "xoxb-", "xoxp-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_")


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    moved = s[4:] + s[:4]
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def describe(text: str, span: Span) -> list[float]:
    """Format and context features of a candidate."""
    begin, end, kind = span
    s = text[begin:end]
    before, after = text[max(0, begin - _AROUND) : begin].lower(), text[end : end + _AROUND].lower()
    digits = only_digits(s)
    n = max(len(s), 1)
    counts = [s.count(c) for c in set(s)]
    entropy = -sum(c / n * math.log2(c / n) for c in counts)
    groups = re.findall(r"[0-9]+", s)
    row = [float(kind == k) for k in KINDS]
    row += [len(s), len(digits), len(digits) / n, sum(c.isupper() for c in s) / n, sum(c.islower() for c in s) / n, entropy, len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0)]
    row += [s.count(" "), s.count("-"), s.count("."), s.count(":"), float(luhn(digits)) if digits else 0.0, float(iban_ok(s)) if kind == "iban" else 0.0]
    row += [float(bool(re.fullmatch(r"(19|20)\d\d[-./ ]?[01]?\d[-./ ]?[0-3]?\d", s))), float(s[:4] in ("AKIA", "ASIA")), float(kind == "secret" and s.startswith(_KEY_STARTS)), float(s.startswith("00")), float("at" in s and kind == "email")]
    row += [float(digits[:1] in ("0", "1")) if digits else 0.0, float(digits[:3] in ("000", "666") or digits[:1] == "9") if kind == "ssn" else 0.0]
    row += [float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before.rstrip(" \"'")[-1:] in ("=", ":"))]
    row += [float(any(w in before for w in words)) for words in _CUES.values()]
    row += [float(any(w in after for w in words)) for words in _CUES.values()]
    return row


# --- generated training texts ---

_FILLER = "the of and to in was with that from this able ning ther ation ouse enter plain river stone morning letter paper small green wide again under between".split()


def _random_case(rng: random.Random) -> tuple[str, str, str, bool]:
    """(kind, span text, cue word or "", is personal)."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    w = lambda: rng.choice(_FILLER)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    alnum = lambda n: "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ0123456789") for _ in range(n))

    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    mixed = lambda n: "".join(rng.choice(letters + "0123456789") for _ in range(n))
    length = lambda: rng.choice([24, 40, 56, 80, 120, 180, 300, 600])

    def key() -> str:
        n = length()
        return rng.choice(_KEY_STARTS) + (mixed(n) if rng.random() < 0.6 else "".join(rng.choice(letters) for _ in range(n)))

    def card() -> str:
        base = rng.choice("3456") + d(14)
        digits = next(base + x for x in "0123456789" if luhn(base + x))
        return rng.choice([".".join, " ".join, "-".join])(digits[i : i + 4] for i in range(0, 16, 4))

    def iban() -> str:
        land, body = rng.choice(["DE", "FR", "ES", "GB", "NL"]), d(18)
        check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
        s = f"{land}{check:02d}{body}"
        return s if rng.random() < 0.5 else " ".join(s[i : i + 4] for i in range(0, len(s), 4))

    def bad_card() -> str:
        while luhn(only_digits(s := " ".join(d(4) for _ in range(4)))):
            pass
        return s

    make = [
        ("email", lambda: f"{w()}.{w()}{rng.choice([' (at) ', '[at]', ' [at] '])}{w()}{rng.choice(['.', ' (dot) ', '[dot]'])}{rng.choice(['com', 'org', 'net', 'de'])}", True),
        ("email", lambda: f"{w()} (at) {w()} [dot] {d(2)}", False),
        ("ip", lambda: ":".join(hexa(4) for _ in range(8)), True),
        ("ip", lambda: ":".join(d(2) for _ in range(4)), False),
        ("card", card, True),
        ("card", bad_card, False),
        ("card", lambda: d(13), False),
        ("card", lambda: d(17), False),
        ("phone", lambda: f"({rng.randint(201, 989)}) {rng.randint(200, 999)}-{d(4)}", True),
        ("phone", lambda: f"{rng.randint(201, 989)}{rng.choice('.- ')}{rng.randint(200, 999)}{rng.choice('.- ')}{d(4)}", True),
        ("phone", lambda: f"0{d(3)} {d(3)} {d(4)}", True),
        ("phone", lambda: f"{rng.choice(['19', '20'])}{d(2)}-{d(4)}", False),
        ("phone", lambda: f"{d(2)} {d(3)} {d(3)}", False),
        ("phone", lambda: f"{d(3)}.{d(4)}", False),
        ("secret", lambda: "AKIA" + alnum(16), True),
        ("secret", lambda: hexa(rng.choice([18, 32, 40, 64, 96, 128, 256])), True),
        ("secret", lambda: hexa(rng.choice([32, 40, 64, 96, 128, 256])), False),
        ("secret", key, True),
        ("secret", lambda: mixed(length()), True),
        ("secret", lambda: "eyJ" + ".".join(mixed(length()) for _ in range(3)), True),
        ("iban", iban, True),
        ("iban", lambda: f"{rng.choice(['AB', 'XQ', 'DE'])}{d(2)} {alnum(4)} {alnum(4)} {alnum(4)}", False),
        ("ssn", lambda: f"{rng.randint(100, 660)}-{d(2)}-{d(4)}", True),
        ("ssn", lambda: f"9{d(2)}-{d(2)}-{d(4)}", False),
        ("ssn", lambda: f"{d(3)} {d(2)} {d(4)}", False),
    ]
    kind, text, personal = rng.choice(make)
    needs_cue = kind in ("ssn",) or (kind == "secret" and personal)
    cue = rng.choice(_CUES[kind]) if personal and (needs_cue or rng.random() < 0.7) else ""
    s = text()
    if kind == "secret" and personal and s.startswith(("AKIA", *_KEY_STARTS)) and rng.random() < 0.7:
        cue = ""
    if not personal and rng.random() < 0.6:
        cue = rng.choice(_CUES["other"])
    return kind, s, cue, personal


def training_rows(n: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, kinds, labels) of the candidates that the generators find in n generated texts."""
    rng = random.Random(seed)
    x, kinds, y = [], [], []
    for _ in range(n):
        kind, s, cue, personal = _random_case(rng)
        words = [rng.choice(_FILLER) for _ in range(rng.randint(2, 8))]
        link = rng.choice([" ", ": ", " = ", "="]) if cue else " "
        text = " ".join(words) + f" {cue}{link}" if cue else " ".join(words) + " "
        begin = len(text)
        text += s + rng.choice([" ", ". ", ", ", "\n"]) + " ".join(rng.choice(_FILLER) for _ in range(4))
        for c in candidates(text, base_spans(text)):
            inside = c[0] < begin + len(s) and c[1] > begin
            exact = abs(c[0] - begin) <= 1 and abs(c[1] - begin - len(s)) <= 1
            if inside:
                x.append(describe(text, c))
                kinds.append(KINDS.index(c[2]))
                y.append(float(personal and exact and c[2] == kind))
    return np.array(x), np.array(kinds), np.array(y)


@dataclass
class Detector:
    base: float
    trees: list[Tree]
    slope: np.ndarray  # calibration of the raw score, a kind
    offset: np.ndarray
    threshold: np.ndarray

    def probability(self, x: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        for t in self.trees:
            raw += t.predict(x)
        return 1 / (1 + np.exp(-(self.slope[kinds] * raw + self.offset[kinds])))

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """(base spans, all spans): the likeliest candidates above their thresholds that overlap nothing chosen.

        Of equally likely ones that overlap the earlier goes first, then the kind listed first.
        """
        base = base_spans(text)
        found = candidates(text, base)
        if not found:
            return base, base
        kinds = np.array([KINDS.index(c[2]) for c in found])
        p = self.probability(np.array([describe(text, c) for c in found]), kinds)
        chosen: list[Span] = []
        begins: list[int] = []  # of the chosen spans in text order, and their ends
        ends: list[int] = []
        for i in np.lexsort((kinds, [c[0] for c in found], -p)).tolist():
            if p[i] < self.threshold[kinds[i]]:
                continue
            a, b, _ = found[i]
            k = bisect.bisect_left(begins, b)
            if not k or ends[k - 1] <= a:
                chosen.append(found[i])
                begins.insert(k, a)
                ends.insert(k, b)
        return base, sorted(base + chosen, key=lambda s: (s[0], KINDS.index(s[2])))


@lru_cache(maxsize=1)
def trained(texts: int = 6000, trees: int = 60, depth: int = 4, precision: float = 0.97) -> Detector:
    """Fit on generated texts; calibrate and choose thresholds on others."""
    x, _, y = training_rows(texts, 11)
    base, forest = boost(x, y, trees, depth)
    out = Detector(base, forest, np.ones(len(KINDS)), np.zeros(len(KINDS)), np.full(len(KINDS), 0.5))
    vx, vk, vy = training_rows(texts // 2, 12)
    raw = np.full(len(vx), base) + sum(t.predict(vx) for t in forest)
    for k in range(len(KINDS)):
        r, t = raw[vk == k], vy[vk == k]
        if len(np.unique(t)) < 2:
            continue
        a, b = 1.0, 0.0
        for _ in range(50):  # Newton steps of Platt's scaling, with a small ridge
            p = 1 / (1 + np.exp(-np.clip(a * r + b, -30, 30)))
            w = p * (1 - p) + 1e-6
            grad = np.array([(p - t) @ r + 0.1 * (a - 1), (p - t).sum()])
            hess = np.array([[(w * r) @ r + 0.1, w @ r], [w @ r, w.sum() + 1e-3]])
            step = np.linalg.solve(hess, grad)
            a, b = a - 0.5 * step[0], b - 0.5 * step[1]
        out.slope[k], out.offset[k] = a, b
        p = 1 / (1 + np.exp(-np.clip(a * r + b, -30, 30)))
        order = np.argsort(-p)
        good = np.flatnonzero(np.cumsum(t[order]) / np.arange(1, len(t) + 1) >= precision)
        out.threshold[k] = max(0.5, float(p[order][good[-1]])) if len(good) else 1.0
    return out


_TRIGGER = np.zeros(256, dtype=bool)
_TRIGGER[48:58] = True
_TRIGGER[[64, 61]] = True  # @ =
_WORDS = r"(?i:[\[(]at[\])]|(?:password|passwd|pwd|token|secret|api[_-]?key)[\"']? ?:)|gh[pousr]_|sk-|xox[abp]-|A[KS]IA|(?:[A-Fa-f]{1,4}:){3}|[a-f]{32}"


def _suspects(texts: pa.Array) -> np.ndarray:
    """Rows that any pattern could match: a digit, @ or =, or what some generator needs in a text without these."""
    data, offs = utf8(texts)

    def having(what: np.ndarray) -> np.ndarray:
        hits = np.concatenate([[0], np.cumsum(what[data], dtype=np.int64)])
        return hits[offs[1:]] > hits[offs[:-1]]

    some = having(_TRIGGER)
    rest = np.flatnonzero(~some)
    some[rest] = pc.fill_null(pc.match_substring_regex(texts.take(pa.array(rest)), _WORDS), False).to_numpy(zero_copy_only=False)
    return some


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find_pii(docs: DataFrame, detector: Detector | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row.

    Counts and digest are of base spans, in code points; spans has them all.  Null and
    empty texts have no spans; texts of any length are searched whole; repeated rows give
    repeated results, an empty table an empty one.  A null doc_id stays null; columns
    other than doc_id and text are not read.
    """
    bound_batches(docs.sparkSession)
    detector = detector or trained()
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) __text")
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                texts = column(part, "__text")
                n = np.zeros((len(BASE), part.num_rows), dtype=np.int64)
                sha, spans = [empty] * part.num_rows, [""] * part.num_rows
                for i in np.flatnonzero(_suspects(texts)).tolist():
                    base, all_ = detector.spans(texts[i].as_py() or "")
                    for s in base:
                        n[BASE.index(s[2]), i] += 1
                    sha[i], spans[i] = hashlib.sha256(joined(base).encode()).hexdigest(), joined(all_)
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), *map(pa.array, n), pa.array(sha, pa.string()), pa.array(spans, pa.string())], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return docs.mapInArrow(run, "doc_id bigint, " + ", ".join(f"n_{k} bigint" for k in BASE) + ", base_sha256 string, spans string")


def redacted(text: str, spans: list[Span]) -> str:
    """Spans, merged where they overlap, give way to the tag of the first kind."""
    out, done = [], 0
    merged: list[list] = []
    for a, b, k in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, k])
    for a, b, k in merged:
        out += [text[done:a], f"<{k}>"]
        done = b
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, detector: Detector | None = None) -> DataFrame:
    """`docs` with every found span replaced by its kind; n_chars, if there, is counted anew in such rows.

    Null and empty texts stay as they are, and so do all other columns, whatever their
    names; repeated rows stay, an empty table gives an empty one.
    """
    bound_batches(docs.sparkSession)
    detector = detector or trained()
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = column(part, "text")
                changed: dict[int, str] = {}
                for i in np.flatnonzero(_suspects(texts)).tolist():
                    text = texts[i].as_py()
                    if text and (all_ := detector.spans(text)[1]):
                        changed[i] = redacted(text, all_)
                if changed:
                    values = texts.to_pylist()
                    for i, t in changed.items():
                        values[i] = t
                    part = part.set_column(part.schema.get_field_index("text"), part.schema.field("text"), pa.array(values, texts.type))
                    if (k := part.schema.get_field_index("n_chars")) >= 0:
                        counts = part.column(k).to_pylist()
                        for i, t in changed.items():
                            counts[i] = len(t)
                        part = part.set_column(k, part.schema.field(k), pa.array(counts, part.schema.field(k).type))
                yield part

    return docs.mapInArrow(run, schema)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {"op7_pii": op7_pii}

"""Personal data: base patterns, and more spans by weak supervision.

Regex, gazetteer and context labelers vote for, against, or not at all on every
candidate span of the corpus.  Expectation maximisation on the counts of vote
patterns (a table of bounded size, summed over all documents) estimates for
each kind how reliable each labeler is; the posterior it gives to each pattern
trains a logistic span classifier.  That sees the votes, the kind and the length
of a span, and what no labeler sees: *marks*, hashed trigrams of the span's
shape and hashed words beside it.  All patterns train it with their full counts;
marks are learned from a bounded sample, about PER_KIND different ones of each
kind.  The classifier decides on each candidate beyond the base spans, which
always stay.  All kinds have equal weight: with the same shares of patterns
within each kind, neither the size of the corpus nor the number of spans of any
kind changes what is taken.

Defined results: a null text is empty; spans are in code points, end exclusive;
equal rows give equal rows; an empty table gives no rows; columns not named are
not read or, in ``redact``, passed through.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

Span = tuple[int, int, str, int]  # start, place of the kind, kind, end

#: Kinds, the base ones first and in the order in which ties are listed.
KINDS = ("email", "ip", "card", "phone", "email_spelled", "phone_national", "ssn", "iban", "name")
_LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive quantifiers where no shorter run could match, so that long runs cost no more than their length.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# Nothing shorter than a whole run of digits could begin one, as a match ends with a whole run too.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_WORD = re.compile(r"[^\W\d_]+")
_EXTRA = {
    "email_spelled": re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,63}(?: ?(?:[(\[]dot[)\]]|\.) ?[A-Za-z]{2,24}){1,4}"),
    "phone_national": re.compile(r"(?<![0-9+.-])(?:\([0-9]{2,4}\) ?|0[0-9]{1,4}[ /-]|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{3,4}(?![0-9.-])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "name": re.compile(r"(?<![^\W_])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Señor|Señora)\.? [^\W\d_a-zß-ÿ][^\W\d_]{1,30}(?: [^\W\d_a-zß-ÿ][^\W\d_]{1,30})?"),
}
#: Gazetteers and context words.
_ENDINGS = set("com org net edu gov mil int info biz name io co ai app dev me tv ac at au be br ca ch cl cn cz de dk es eu fi fr gr hu ie il in it jp kr lu mx nl no nz pl pt ro ru se sk tr ua uk us za".split())
_COUNTRIES = set("AD AE AL AT AZ BA BE BG BH BR BY CH CR CY CZ DE DK DO EE EG ES FI FO FR GB GE GI GL GR GT HR HU IE IL IS IT JO KW KZ LB LC LI LT LU LV MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SE SI SK SM TN TR UA VA XK".split())
_GIVEN = set(
    "adam adrian alan albert alex alexander alice amy ana andrea andrew angela anna anne antonio arthur barbara ben benjamin carl carlos carmen caroline catherine charles charlotte chris christian christina claire claudia "
    "daniel david diana diego edward elena elisabeth elizabeth emily emma eric eva felix fernando florian francisco frank gabriel george hannah hans heinz helen henri henry ines isabel jack jacques james jan jane jean "
    "jennifer john jonas jorge jose joseph juan julia julie karen karl katharina kevin klaus laura lena leon lisa louis lucas lucia luis manuel marc marco maria marie mark markus martin mary max michael miguel monica nancy "
    "nicolas nicole olivia oliver oscar pablo patricia paul pedro peter philip philippe pierre rachel rafael ralf richard robert rosa sabine sandra sarah sebastian simon sofia sophie stefan stephen susan teresa thomas "
    "tim tom ursula victor werner william wolfgang".split()
)
_FOR = re.compile(r"\b(?:call|tel|phone|fax|mobile|contact|mail|email|e-mail|write|ssn|social security|iban|account|konto|compte|cuenta|name|nom|nombre|dear|signed|address|card|ip)\b", re.I)
_AGAINST = re.compile(r"\b(?:isbn|issn|version|page|chapter|figure|table|section|order|invoice|serial|part|score|lines?)\b", re.I)
ACCEPT = 0.9
#: Buckets of marks, what the classifier's penalty holds them down by, and the sample they are learned from.
MARKS, MARK_PENALTY, PER_KIND = 256, 20.0, 300
#: Weight of each kind, whatever its number of spans: what the prior counts and the penalty are held against.
KIND_WEIGHT = 1000.0


def base_spans(text: str) -> list[Span]:
    """Base spans, leftmost and non-overlapping within each kind; linear in the text."""
    out: list[Span] = []
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, 0, "email", end))
        else:
            end = max(end, at + 1)  # no local part reaches over an @
        at = text.find("@", max(at + 1, end))
    out += [(m.start(), 1, "ip", m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            out.append((m.start(), 2, "card", m.end()))
    out += [(m.start(), 3, "phone", m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out)


def luhn(digits: str) -> bool:
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = int(c) * (1 + n % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _valid(kind: str, text: str) -> int:
    """The checking labeler: 1, -1 or 0."""
    if kind == "iban":
        raw = text.replace(" ", "")
        return 1 if int("".join(str(int(c, 36)) for c in raw[4:] + raw[:4])) % 97 == 1 else -1
    if kind == "ssn":
        return -1 if text[:3] in ("000", "666") or text[0] == "9" or text[4:6] == "00" or text[-4:] == "0000" else 1
    if kind == "phone_national":
        return 1 if 9 <= len(_NOT_DIGIT.sub("", text)) <= 12 else -1
    return 1 if kind in ("card", "ip", "phone") else 0


def _listed(kind: str, text: str) -> int:
    """The gazetteer labeler."""
    if kind in ("email", "email_spelled"):
        return 1 if re.split(r"[^A-Za-z]+", text.rstrip(")] "))[-1].lower() in _ENDINGS else -1
    if kind == "iban":
        return 1 if text[:2] in _COUNTRIES else -1
    if kind == "name":
        return 1 if any(x.lower() in _GIVEN for x in text.split()[1:]) else 0
    return 0


def _apart(base: list[Span], extra: list[Span]) -> list[Span]:
    """Those of ``extra`` that touch no character of ``base`` (sorted)."""
    starts, reach = [x[0] for x in base], list(accumulate((x[3] for x in base), max))
    out = []
    for x in extra:
        before = bisect_left(starts, x[3])  # base spans that start before its end
        if not before or reach[before - 1] <= x[0]:
            out.append(x)
    return out


def marks(place: int, shown: str, left: str, right: str) -> list[int]:
    """Buckets of the trigrams of a span's shape and of the words beside it."""
    shape = f"^{''.join('0' if c.isdigit() else 'A' if c.isupper() else 'a' if c.isalpha() else c for c in shown)}$"
    seen = {shape[n : n + 3] for n in range(len(shape) - 2)}
    seen |= {f"<{w}" for w in _WORD.findall(left.lower())[-3:]} | {f">{w}" for w in _WORD.findall(right.lower())[:2]}
    return sorted({zlib.crc32(f"{place}{x}".encode("utf-8", "surrogatepass")) % MARKS for x in seen})


def candidates(text: str) -> tuple[list[Span], list[tuple[int, int, str, int, str, list[int]]]]:
    """Base spans, and (start, place, kind, end, pattern, marks) of all candidates.

    A pattern is the kind, the votes and the length class of a span; base spans have no marks.
    """
    base = base_spans(text)
    extra: list[Span] = []
    for place, kind in enumerate(KINDS[4:], 4):
        if kind == "email_spelled" and not re.search(r"[(\[]at[)\]]", text):
            continue
        extra += [(m.start(), place, kind, m.end()) for m in _EXTRA[kind].finditer(text)]
    free = _apart(base, extra)
    every, out = sorted(base + free), []
    for n, (start, place, kind, end) in enumerate(every):
        shown, left, right = text[start:end], text[max(0, start - 40) : start], text[end : end + 20]
        beside = any(0 <= n + k < len(every) and every[n + k][2] != kind and abs(every[n + k][0] - start) < 120 for k in (-1, 1))
        edge = not (left[-1:].isalnum() or right[:1].isalnum())
        votes = (
            1 if place < 4 else 0,
            1 if edge else -1,
            _valid(kind, shown),
            _listed(kind, shown),
            1 if _FOR.search(left) else -1 if _AGAINST.search(left) else 0,
            1 if beside else 0,
        )
        length = min(3, (end - start) // 8)
        out.append((start, place, kind, end, f"{place}|{','.join(map(str, votes))}|{length}", marks(place, shown, left, right) if place >= 4 else []))
    return base, out


# ---- what the votes of the corpus say -------------------------------------------------------


def _parse(pattern: str) -> tuple[int, list[int], int]:
    place, votes, shape = pattern.split("|")
    return int(place), [int(x) for x in votes.split(",")], int(shape)


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """EM for two classes and labelers independent given the class.

    Returns the posterior of each vote pattern, and the probability of each
    vote (-1, 0, 1) of each labeler given each class.
    """
    post = np.clip(0.5 + 0.2 * votes.sum(axis=1), 0.05, 0.95)
    table = np.full((2, votes.shape[1], 3), 1 / 3)
    for _ in range(rounds):
        for c, weight in enumerate((counts * (1 - post), counts * post)):
            for j in range(votes.shape[1]):
                seen = np.array([weight[votes[:, j] == v].sum() for v in (-1, 0, 1)])
                # Prior counts: a labeler is somewhat better than chance.
                table[c, j] = (seen + (np.array([1, 1, 2]) if c else np.array([2, 1, 1]))) / (seen.sum() + 4)
        prior = (counts @ post + 1) / (counts.sum() + 2)
        logit = np.log(prior / (1 - prior)) + sum(np.log(table[1, j, votes[:, j] + 1] / table[0, j, votes[:, j] + 1]) for j in range(votes.shape[1]))
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return post, table


def _features(places: np.ndarray, votes: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    one = [np.ones(len(places))] + [places == k for k in range(len(KINDS))] + [shapes == k for k in range(4)]
    return np.column_stack([*one, *(votes[:, j] == v for j in range(votes.shape[1]) for v in (-1, 1))]).astype(float)


def classifier(x: np.ndarray, y: np.ndarray, counts: np.ndarray, penalty: np.ndarray | float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression on soft labels, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (counts * (y - p)) - penalty * w
        w = w + np.linalg.solve(x.T @ (x * (counts * p * (1 - p))[:, None]) + np.diag(np.broadcast_to(penalty, len(w))), slope)
    return w


@dataclass
class Model:
    """Weights of the span classifier."""

    patterns: np.ndarray
    marks: np.ndarray

    def probability(self, pattern: str, found: list[int] = ()) -> float:
        """That a span of a vote pattern and marks is personal data."""
        places, votes, lengths = (np.array([x]) for x in _parse(pattern))
        z = float(_features(places, votes, lengths)[0] @ self.patterns) + float(self.marks[list(found)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -700, 700))))

    def accepts(self, pattern: str, found: list[int] = ()) -> bool:
        return self.probability(pattern, found) >= ACCEPT


def train(histogram: dict[str, int], sample: list[tuple[str, list[int], int]] = ()) -> Model:
    """The classifier from the counts of all patterns, and (pattern, marks, count) of some spans.

    A pattern's weight, that of its count, is shared out among its sampled spans.
    """
    if not histogram:
        return Model(np.zeros(_features(np.zeros(1), np.zeros((1, 6)), np.zeros(1)).shape[1]) - 1e3, np.zeros(MARKS))
    keys = sorted(histogram)
    places, votes, lengths = (np.array(x) for x in zip(*map(_parse, keys), strict=True))
    counts = np.array([histogram[k] for k in keys], float)
    post = np.zeros(len(keys))
    for kind in np.unique(places):
        own = places == kind
        counts[own] *= KIND_WEIGHT / counts[own].sum()
        post[own], _ = reliabilities(votes[own], counts[own])
    at = {k: n for n, k in enumerate(keys)}
    sample = sorted(x for x in sample if x[0] in at)
    shares = np.zeros(len(keys))
    for pattern, _, n in sample:
        shares[at[pattern]] += n
    rows = [(at[p], m, counts[at[p]] * n / shares[at[p]]) for p, m, n in sample] + [(n, (), counts[n]) for n in np.flatnonzero(shares == 0).tolist()]
    own, seen = np.array([n for n, *_ in rows]), np.zeros((len(rows), MARKS))
    for n, (_, m, _) in enumerate(rows):
        seen[n, list(m)] = 1
    x = np.column_stack([_features(places, votes, lengths)[own], seen])
    penalty = np.concatenate([np.ones(x.shape[1] - MARKS), np.full(MARKS, MARK_PENALTY)])
    w = classifier(x, post[own], np.array([c for *_, c in rows]), penalty)
    return Model(w[:-MARKS], w[-MARKS:])


def accepted(histogram: dict[str, int]) -> set[str]:
    """Patterns that the classifier trained on their counts alone takes for personal data."""
    model = train(histogram)
    return {k for k in histogram if model.accepts(k)}


# ---- the corpus -----------------------------------------------------------------------------

_ROW = "doc_id long, base array<struct<start:int,place:int,kind:string,end:int>>, found array<struct<start:int,place:int,kind:string,end:int,pattern:string,marks:array<int>>>"
_FIELDS = ("start", "place", "kind", "end", "pattern", "marks")


def votes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, base spans and candidates with their vote patterns and marks, of every row."""
    common.ship_package(docs.sparkSession)
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.int32())]
    one = [pa.list_(pa.struct(list(zip(_FIELDS[:n], kinds[:n], strict=True)))) for n in (4, 6)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            made = [candidates(x or "") for x in batch.column(1).to_pylist()]
            lists = [[[dict(zip(_FIELDS, s, strict=False)) for s in m[k]] for m in made] for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists[0], one[0]), pa.array(lists[1], one[1])], ["doc_id", "base", "found"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, _ROW)


def learn(rows: DataFrame) -> Model:
    """The classifier from the votes of all rows; the driver sees one count per pattern and about PER_KIND marks of each kind."""
    groups = rows.select(F.explode("found").alias("x")).groupBy("x.pattern", "x.marks").agg(F.count("*").alias("n"))
    groups = common.materialise(groups, "patterns")
    histogram = {r.pattern: r.n for r in groups.groupBy("pattern").agg(F.sum("n").alias("n")).collect()}
    kind = F.substring_index("pattern", "|", 1)
    marked = groups.where(F.size("marks") > 0).withColumn("place", kind)
    shares = [(r.place, PER_KIND / r.n) for r in marked.groupBy("place").agg(F.count("*").alias("n")).collect()]
    unit = F.shiftrightunsigned(F.xxhash64(F.lit("marks"), "pattern", "marks"), 11) / F.lit(float(1 << 53))
    table = F.broadcast(rows.sparkSession.createDataFrame(shares, "place string, share double"))  # a row for each kind
    picked = marked.join(table, "place").where(unit < F.col("share"))
    return train(histogram, [(r.pattern, list(r.marks), r.n) for r in picked.collect()])


def join_spans(spans: list) -> str:
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)


def digest(rows: DataFrame, model: Model) -> DataFrame:
    """Counts, digest and spans of every row; ``scores`` has kind:start:end:probability of all candidates, base spans too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            out = []
            for name, base, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sure = [model.probability(s["pattern"], s["marks"]) for s in found]
                spans = [s for s, p in zip(found, sure, strict=True) if s["place"] < 4 or p >= ACCEPT]
                scores = ",".join(f"{s['kind']}:{s['start']}:{s['end']}:{p:.4f}" for s, p in zip(found, sure, strict=True))
                out.append((name, *(sum(s["place"] == k for s in base) for k in range(4)), hashlib.sha256(join_spans(base).encode()).hexdigest(), join_spans(spans), scores))
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n < 5 else pa.string()) for n, c in enumerate(columns)], names)

    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores"]
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string")


def find(docs: DataFrame, **columns: str) -> DataFrame:
    rows = common.materialise(votes(docs, **columns), "votes")
    return digest(rows, learn(rows))


def redact_text(text: str, model: Model) -> str:
    """``text`` with each run of touching spans replaced by the kind of its first, in brackets."""
    base, found = candidates(text)
    out, at = [], 0
    for start, place, kind, end, pattern, seen in found:
        if place >= 4 and not model.accepts(pattern, seen):
            continue
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame, model: Model, text_column: str = "text", size_column: str = "n_chars") -> DataFrame:
    """``docs``, all columns, with personal data replaced and ``size_column``, if there, kept true."""
    common.ship_package(docs.sparkSession)
    at, sized = docs.columns.index(text_column), docs.columns.index(size_column) if size_column in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            clean = [x if x is None else redact_text(x, model) for x in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(clean, batch.schema.field(at).type)
            if sized is not None:
                columns[sized] = pa.array([o if x is None else len(x) for x, o in zip(clean, batch.column(sized).to_pylist(), strict=True)], batch.schema.field(sized).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return common.map_rows(docs, run)

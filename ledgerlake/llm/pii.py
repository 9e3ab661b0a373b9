"""Personal data by fixed patterns and a skip-chain conditional random field.

Patterns give the base spans. The field's nodes are these and other runs that might be personal
data: words with an at sign, and runs of digits and separators. Its labels are O, email, ip, card and
phone. A node's potential is a learned linear function of its shape and its neighbouring words;
neighbouring nodes share a chain potential; nodes of equal or similar content, however far
apart, share a skip potential that rewards equal labels. Base spans are observed. Loopy message
passing then spreads their labels: a number that the patterns miss, such as a phone without
its plus sign, is found where the document also has it in full. A node is added if one label has
a probability of ADD or more.

The potentials are learned piecewise (nodes, chain, skip) from the base spans of a bounded sample:
about FIT_DOCS documents, those with the smallest hash of doc_id.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import slices, table, text_or_empty, thrifty

# The kinds in order, their patterns, and their limits. The look-behind and the possessive signs
# leave what is matched as it is and make the search linear.
KINDS = ("email", "ip", "card", "phone")
AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

DIGIT = re.compile(r"[0-9]")
WORD_END = re.compile(r"[\s@,;:<>()\"'|]")
AFTER_AT = re.compile(r"[^\s,;:<>()\"'|]*")
NUMBER = re.compile(r"(?<![+(])[+(]*+[0-9][0-9().\x20/-]*[0-9]")
NUMBER_WITHOUT_BLANK = re.compile(r"(?<![+(])[+(]*+[0-9][0-9()./-]*[0-9]")
LEAST_DIGITS, MOST_DIGITS = 7, 24

FIT_DOCS, FIT_NODES = 20_000, 200  # documents of the fit, and about how many nodes of one; drawn by hash, from all
NEAR = 40  # characters between nodes that share a chain potential
FEATURES = 256
AGREE, DISAGREE = 3000.0, 1.0  # prior counts of the skip potential
ADD = 0.9
SWEEPS, DAMPED_FROM, DAMPING = 200, 50, 0.3

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """By start, then kind; each kind is matched leftmost and without overlap, and matches that fail its limits are dropped."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = AT.match(text, at) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(done, at + 1))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text) if "+" in text else ():
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


@dataclass
class Node:
    start: int
    end: int
    label: int  # 0 or 1 + kind
    base: bool
    key: str  # what equal and similar nodes have in common


def _key(text: str) -> str:
    if "@" in text:
        return text.lower().rstrip(".")
    return "".join(c for c in text if "0" <= c <= "9")


def _words_with_at(text: str) -> list[tuple[int, int]]:
    """Leftmost runs with an at sign that something stands before. Each sign looks back no farther than to the one before it, so this is linear."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and not WORD_END.match(text, start - 1):
            start -= 1
        if start < at:
            done = AFTER_AT.match(text, at + 1).end()
            out.append((start, done))
        at = text.find("@", max(done, at + 1))
    return out


def _numbers(text: str, lo: int, hi: int) -> list[tuple[int, int]]:
    """Runs of digits and separators with LEAST_DIGITS to MOST_DIGITS digits. A longer run is a list of numbers: what blanks part in it is taken one by one."""
    out = []
    for m in NUMBER.finditer(text, lo, hi):
        for a, b in [m.span()] if sum("0" <= c <= "9" for c in m[0]) <= MOST_DIGITS else [p.span() for p in NUMBER_WITHOUT_BLANK.finditer(text, *m.span())]:
            if LEAST_DIGITS <= sum("0" <= c <= "9" for c in text[a:b]) <= MOST_DIGITS:
                out.append((a, b))
    return out


def nodes(text: str, base: list[Span]) -> list[Node]:
    """Base spans, and what else might be personal data and overlaps none of them, in order. Time is linear in the text."""
    out = [Node(a, b, 1 + k, True, _key(text[a:b])) for a, k, b in base]
    taken, last = sorted((a, b) for a, _, b in base), -1
    found = _words_with_at(text)
    if DIGIT.search(text):
        lo = 0
        for a, b in [*taken, (len(text), len(text))]:  # numbers stand between base spans
            if a > lo:
                found += _numbers(text, lo, a)
            lo = max(lo, b)
    free, k = [], 0
    for a, b in sorted(found):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if (k == len(taken) or taken[k][0] >= b) and a >= last:
            free.append(Node(a, b, 0, False, _key(text[a:b])))
            last = b
    return sorted(out + free, key=lambda n: (n.start, n.label))


def features(text: str, n: Node) -> np.ndarray:
    own = text[n.start : n.end]
    digits = sum("0" <= c <= "9" for c in own)
    names = ["all", f"digits{min(digits, 24)}", f"dots{min(own.count('.'), 4)}", f"plus{own[:1] == '+'}", f"at{'@' in own}", f"minus{'-' in own}", f"brace{'(' in own}", f"blank{' ' in own}"]
    if 12 <= digits <= 19:
        names.append(f"luhn{luhn(''.join(c for c in own if '0' <= c <= '9'))}")
    for side, words in (("before", text[max(0, n.start - 40) : n.start].split()[-1:]), ("after", text[n.end : n.end + 40].split()[:1])):
        names += [f"{side}:{w.lower().strip('.,;:!?')}" for w in words]
    return np.unique([zlib.crc32(x.encode("utf-8", "surrogatepass")) % FEATURES for x in names]).astype(np.uint8)


def edges(found: list[Node]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges between neighbours, and skip edges: each node to the one before of equal key, and of equal last 9 digits; so as many as nodes, not as pairs."""
    chain = [(k - 1, k) for k in range(1, len(found)) if found[k].start - found[k - 1].end <= NEAR]
    skip, last = set(), {}
    for k, n in enumerate(found):
        for key in {n.key, n.key[-9:] if n.key.isdigit() and len(n.key) >= 9 else n.key}:
            if (j := last.get(key)) is not None:
                skip.add((j, k))
            last[key] = k
    return chain, sorted(skip)


def marginals(unary: np.ndarray, chain: list[tuple[int, int]], skip: list[tuple[int, int]], chain_potential: np.ndarray, skip_potential: np.ndarray) -> np.ndarray:
    """Label probabilities of each node by loopy sum-product; exact where the edges form a forest.

    Messages go in sweeps, to later nodes in order and then to earlier ones, each from the newest
    messages: one sweep takes a label along a chain of any length. Sweeps end when no message moves;
    only where edges close a loop, for which nothing promises that, are they damped after DAMPED_FROM sweeps and ended after SWEEPS.
    """
    links = sorted([*((a, b, 0) for a, b in chain), *((a, b, 1) for a, b in skip)])
    factors = [np.exp(x) for x in (chain_potential, skip_potential)]
    loops = _closes_loop(len(unary), links)
    belief = unary.astype(float)
    later, earlier = (np.zeros((len(links), unary.shape[1])) for _ in range(2))
    forward = [(e, a, b, factors[x]) for e, (a, b, x) in enumerate(links)]
    backward = [(e, b, a, factors[x].T) for e, (a, b, x) in sorted(enumerate(links), key=lambda l: (-l[1][1], -l[1][0]))]
    sweep, moved = 0, 1.0
    while links and moved >= 1e-6 and (not loops or sweep < SWEEPS):
        moved, step = 0.0, 1 - DAMPING if loops and sweep >= DAMPED_FROM else 1.0
        for order, sent, received in ((forward, later, earlier), (backward, earlier, later)):
            for e, source, target, factor in order:
                rest = belief[source] - received[e]
                new = np.log(np.maximum(np.exp(rest - rest.max()) @ factor, 1e-300))
                change = step * (new - new.max() - sent[e])
                sent[e] += change
                belief[target] += change
                moved = max(moved, np.abs(change).max())
        sweep += 1
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _closes_loop(n: int, links: list[tuple[int, int, int]]) -> bool:
    top = list(range(n))
    for a, b, _ in links:
        while top[a] != a:
            top[a] = a = top[top[a]]
        while top[b] != b:
            top[b] = b = top[top[b]]
        if a == b:
            return True
        top[b] = a
    return False


@dataclass
class Field:
    weights: np.ndarray  # FEATURES x labels
    chain: np.ndarray
    skip: np.ndarray

    def added(self, text: str, base: list[Span]) -> list[Span]:
        found = nodes(text, base)
        if all(n.base for n in found):
            return []
        unary = np.stack([self.weights[features(text, n)].sum(0) for n in found])
        for k, n in enumerate(found):
            if n.base:
                unary[k] = -50
                unary[k, n.label] = 0
        p = marginals(unary, *edges(found), self.chain, self.skip)
        return [(n.start, int(q.argmax()) - 1, n.end) for n, q in zip(found, p) if not n.base and q[1:].max() >= ADD]


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS) -> Field:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    most = int(min(1.0, fit_docs / max(1, docs.count())) * (1 << 40))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch["text"].to_pylist():
                base = base_spans(text)
                found = nodes(text, base)
                chain, skip = edges(found)
                drawn = found if len(found) <= FIT_NODES else [n for n in found if zlib.crc32(f"{n.start} {n.key}".encode()) * len(found) < FIT_NODES << 32]
                rows += [(0, features(text, n).tobytes(), n.label, 0) for n in drawn]
                rows += [(1, b"", found[a].label, found[b].label) for a, b in chain]
                rows += [(2, b"", found[a].label, found[b].label) for a, b in skip]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.int32(), pa.int32()))], ["what", "features", "a", "b"])

    place = F.xxhash64("doc_id", F.lit(5)).bitwiseAND(F.lit((1 << 40) - 1))
    counted = docs.where(place < most).mapInArrow(thrifty(run), "what int, features binary, a int, b int").groupBy("what", "features", "a", "b").count().collect()
    labels = 1 + len(KINDS)
    pairs = {1: np.full((labels, labels), 0.5), 2: np.full((labels, labels), 0.0)}
    seen, y, weight = [], [], []
    for r in sorted(counted, key=lambda r: (r.what, bytes(r.features), r.a, r.b)):
        if r.what:
            pairs[r.what][r.a, r.b] += r["count"]
        else:
            seen.append(np.frombuffer(bytes(r.features), np.uint8))
            y.append(r.a)
            weight.append(r["count"])
    chain = pairs[1] / pairs[1].sum()
    chain = np.log(chain / np.outer(chain.sum(1), chain.sum(0)))
    kinds = pairs[2][1:, 1:]  # that the patterns miss one of a pair is no evidence against it
    rate = np.log((np.trace(kinds) + AGREE) / (kinds.sum() - np.trace(kinds) + DISAGREE))
    return Field(_logistic(seen, np.array(y, int), np.array(weight, float), labels), 0.5 * (chain + chain.T), rate * np.eye(labels))


def _logistic(seen: list[np.ndarray], y: np.ndarray, weight: np.ndarray, labels: int) -> np.ndarray:
    """Multinomial logistic regression with L2, by Adagrad over all counted rows; zero weights without rows."""
    w = np.zeros((FEATURES, labels))
    if not len(y):
        return w
    x = np.zeros((len(seen), FEATURES), np.float32)
    for k, s in enumerate(seen):
        x[k, s] = 1
    goal, total, past = np.eye(labels)[y], weight.sum(), np.full(w.shape, 1e-8)
    for _ in range(150):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = x.T @ ((p - goal) * weight[:, None] / total) + 1e-4 * w
        past += g**2
        w -= 0.3 * g / np.sqrt(past)
    return w


def shown(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, field: Field) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card and n_phone of the base spans, base_sha256 of their list, spans with the added ones, n_added. Null texts count as empty. Positions are in code points, ends exclusive. Texts of any length are read whole, in time linear in them; of two kinds that begin at one place the earlier in KINDS comes first; repeated rows are found in alike, each by itself. Other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch["text"], 1 << 22):
                rows = []
                for text in batch["text"][lo:hi].to_pylist():
                    base = base_spans(text)
                    added = shared.value.added(text, base)
                    n = [0] * len(KINDS)
                    for _, k, _ in base:
                        n[k] += 1
                    rows.append((*n, hashlib.sha256(shown(base).encode()).hexdigest(), shown(sorted(base + added)), len(added)))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch["doc_id"][lo:hi], *columns], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(thrifty(run), schema)


def op8_skipchain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, fit(docs))

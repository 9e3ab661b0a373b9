import hashlib
import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from ledgerlake.llm import pii

SCHEMA = "doc_id long, text string, spans string, n_ip int"


def plain_base(text):
    """The patterns as they are written, by the library alone."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(x) * (1 + k % 2), 10)) for k, x in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("a@.1 0-+(9é٣%_\n25"), max_size=60))
def test_base_spans_equal_the_plain_patterns(text):
    assert pii.base_spans(text) == plain_base(text)


def test_base_spans_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 100_000, "+1(" * 100_000, "1-" * 150_000, "+" * 100_000 + "1 " * 100_000):
        pii.base_spans(text)


def test_nodes_take_linear_time():
    """1 MB runs of what could be searched again from each of its characters."""
    n = 1 << 20
    for text in ("x" * n + " a@b", "(" * n + " 1", "+" * n, "1(" * (n // 2), "1" + "(" * n, "@" * n, "1 " * (n // 2), "x@" * (n // 2), "+1 202 555 1234 " * (n // 16)):
        pii.nodes(text, pii.base_spans(text))


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab@@ ,.(\n1"), max_size=40))
def test_words_with_at_equal_the_plain_pattern(text):
    assert pii._words_with_at(text) == [m.span() for m in re.finditer(r"[^\s@,;:<>()\"'|]+@[^\s,;:<>()\"'|]*", text)]


def test_lists_of_numbers_are_taken_one_by_one():
    text = "call 555-123-4567 555-987-6543 555-111-2222 now"
    assert [text[n.start : n.end] for n in pii.nodes(text, pii.base_spans(text))] == ["555-123-4567", "555-987-6543", "555-111-2222"]
    text = "at 10.1.2.3 555-123-4567 or +1 202 555 1234, 202 555 9876"
    assert [(text[n.start : n.end], n.base) for n in pii.nodes(text, pii.base_spans(text))] == [("10.1.2.3", True), ("555-123-4567", False), ("+1 202 555 1234", True), ("202 555 9876", False)]


def test_a_long_document_takes_part_in_the_fit_with_all_of_its_length(spark):
    """Nodes are drawn from the whole document: what stands at its end only is seen too."""
    docs = spark.createDataFrame([(1, "order 123 456 7890 " * 3000 + "mail a@b.example.com " * 3000, "x", 1)], SCHEMA)
    field = pii.fit(docs)
    alone = pii.Node(0, 18, 0, False, "q@c.example.com")
    assert field.weights[pii.features("mail q@c.example.com", alone)].sum(0).argmax() == 1


def brute_marginals(unary, chain, skip, c, s):
    n, labels = unary.shape
    p = np.zeros((n, labels))
    for y in itertools.product(range(labels), repeat=n):
        e = sum(unary[k, y[k]] for k in range(n)) + sum(c[y[a], y[b]] for a, b in chain) + sum(s[y[a], y[b]] for a, b in skip)
        for k in range(n):
            p[k, y[k]] += np.exp(e)
    return p / p.sum(1, keepdims=True)


@pytest.mark.parametrize("chain,skip,close", [([(0, 1), (1, 2), (2, 3)], [], 1e-4), ([(0, 1)], [(0, 2), (1, 3)], 1e-4), ([(0, 1), (1, 2), (2, 3)], [(0, 3)], 0.08), ([], [], 1e-9)])
def test_messages_against_all_labelings(chain, skip, close):
    """Exact on trees; near on loops."""
    rng = np.random.default_rng(0)
    for _ in range(20):
        unary, c = rng.normal(0, 1, (4, 5)), rng.normal(0, 0.4, (5, 5))
        c, s = c + c.T, 0.8 * np.eye(5)
        assert np.abs(pii.marginals(unary, chain, skip, c, s) - brute_marginals(unary, chain, skip, c, s)).max() < close


@pytest.mark.parametrize("n", [64, 65, 130, 300, 700])
@pytest.mark.parametrize("observed", [0, "middle", "last"])
def test_a_label_reaches_all_occurrences(n, observed):
    """Against exact inference along the chain of equal keys, by forward and backward products."""
    rng = np.random.default_rng(n)
    unary, skip = rng.normal(0, 0.3, (n, 5)), 8 * np.eye(5)
    at = {"middle": n // 2, "last": n - 1}.get(observed, 0)
    unary[at] = -50
    unary[at, 4] = 0
    ahead, back = np.zeros((n, 5)), np.zeros((n, 5))
    for k in range(1, n):
        ahead[k] = np.logaddexp.reduce((ahead[k - 1] + unary[k - 1])[:, None] + skip, axis=0)
        back[n - 1 - k] = np.logaddexp.reduce((back[n - k] + unary[n - k])[:, None] + skip, axis=0)
        ahead[k] -= ahead[k].max()
        back[n - 1 - k] -= back[n - 1 - k].max()
    want = np.exp(unary + ahead + back - (unary + ahead + back).max(1, keepdims=True))
    want /= want.sum(1, keepdims=True)
    got = pii.marginals(unary, [], [(k - 1, k) for k in range(1, n)], np.zeros((5, 5)), skip)
    assert np.abs(got - want).max() < 1e-6
    assert ((got[:, 4] >= pii.ADD) == (want[:, 4] >= pii.ADD)).all()


CARD = "4111 1111 1111 1111"


def corpus():
    rows = []
    for i in range(60):
        rows.append((4 * i, f"call +1 (202) 555-{1000 + i:04} or mail u{i}@mail.example.com today"))
        rows.append((4 * i + 1, f"pay with {CARD} from 10.0.0.{i} now"))
        rows.append((4 * i + 2, f"order 77{i:03}41234567 and 1234567890123{i:03} were sent at 300.1.2.{i}"))
        rows.append((4 * i + 3, "nothing to see"))
    return rows


def test_repeated_content_is_found_and_clean_text_is_left(spark):
    rows = corpus()
    rows += [(900, "call +1 (202) 555-1234 " + "x " * 3000 + "again 1 202.555.1234 thanks"), (901, f"{CARD} then 4111.1111.1111.1111"), (902, "again 1 202.555.1234 thanks"), (903, "2390409500648960 and 2390409500648960")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = {r.doc_id: r for r in pii.find(docs, pii.fit(docs)).collect()}
    assert got[900].n_added == 1 and got[900].spans.count("phone:") == 2 and got[900].n_phone == 1
    assert got[901].n_added == 1 and got[901].spans.count("card:") == 2
    assert got[902].n_added == got[903].n_added == 0
    assert all(got[i].n_added == 0 for i, _ in corpus())
    for i, text in rows:
        base = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in plain_base(text))
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(got[i].spans.split(","))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a@b.cd"), (3, "a@b.cd"), (3, "a@b.cd"), (4, "+1 202 555 1234 " * 3000), (5, "é a@b.cd \U0001f600 10.1.2.3")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = pii.find(docs, pii.fit(docs)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].spans == by[2].spans == "" and by[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[5].spans == "email:2:8,ip:11:19"
    empty = spark.createDataFrame([], SCHEMA)
    assert pii.find(empty, pii.fit(empty)).count() == 0


def test_whole_documents(spark):
    sf = "/root/testdata/sf0.01"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = pii.op8_skipchain_pii(spark, sf).collect()
    assert len(got) == len(text)
    for r in got:
        base = plain_base(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii.shown(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, k, _ in base) for x in range(4)]
    assert sum(r.n_added for r in got) < 10

"""The registered queries of the subpackage on the smallest tables, against plain Python."""

from __future__ import annotations

import collections
import hashlib
import math
import os
import re
import zlib

import pytest

from vicinal.llm import langid, queries, toxicity
from vicinal.llm._session import learnable

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text or "" for r in rows}


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def ascii_lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def test_op1_finds_every_whole_item_and_nothing_without_its_words(spark, texts):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    split = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
    words, wanted = {i: split(t) for i, t in texts.items()}, {i: split(t) for i, t in items.items()}
    got = {(r.doc_id, r.item_id): r for r in queries.op1_decontamination(spark, DATA).collect()}
    joined = {i: " " + " ".join(w) + " " for i, w in words.items()}
    whole = {(d, i) for i, w in wanted.items() for d, t in joined.items() if " " + " ".join(w) + " " in t}
    assert whole and all(got[k].lcs == 1.0 for k in whole)
    for (d, i), r in got.items():  # the share of a region is at most that of the whole text
        table = [0] * (len(words[d]) + 1)
        for x in wanted[i]:
            last = 0
            for j, y in enumerate(words[d], 1):
                last, table[j] = table[j], last + 1 if x == y else max(table[j], table[j - 1])
        assert 0.55 <= r.lcs <= table[-1] / len(wanted[i]) + 1e-9


def test_op2_equals_brute_force(spark, texts):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(t))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op2_near_dedup(spark, DATA).collect()}
    assert got == {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def test_op3_scores_are_those_of_a_linear_model_over_different_words(spark, texts):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels, learnable())
    assert model.weights.any()
    import numpy as np

    def place(word):
        raw = word.encode()
        return int(toxicity.features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0][0])

    got = {r.doc_id: r for r in queries.op3_toxicity(spark, DATA).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        places = {place(w) for w in set(re.findall(r"[0-9a-z\x80-\U0010ffff]+", ascii_lower(t)))}
        score = 1 / (1 + math.exp(-max(-30, min(30, model.bias + sum(float(np.float32(model.weights[p])) for p in places)))))
        assert abs(got[i].score - score) < 1e-4
        assert got[i].held_out == held_out(i) and got[i].predicted == (got[i].score >= 0.3)


def test_op3_risk_is_fitted_and_not_negative():
    import numpy as np

    rng = np.random.default_rng(3)
    toxic = lambda: np.unique(np.append(rng.integers(100, 400, 20), rng.integers(0, 10, 3)))
    clean = lambda: np.unique(rng.integers(100, 400, 22))
    pos, unl, prior = [toxic() for _ in range(150)], [toxic() if rng.random() < 0.2 else clean() for _ in range(900)], 0.2

    def risk(model):
        loss = lambda xs, sign: np.mean([np.log1p(np.exp(-sign * (model.bias + model.weights[x].sum()))) for x in xs])
        return prior * loss(pos, 1), loss(unl, -1) - prior * loss(pos, -1)

    start = toxicity.Model(np.zeros(1 << toxicity.BITS), float(np.log(prior / (1 - prior))))
    model = toxicity.fit(pos, unl, prior)
    positive, negative = risk(model)
    assert positive + max(0, negative) < 0.5 * (risk(start)[0] + risk(start)[1]) and negative > -0.05
    score = lambda x: model.bias + model.weights[x].sum()
    assert min(score(toxic()) for _ in range(50)) > max(score(clean()) for _ in range(50))


def plain_spans(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        total = sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(reversed(digits)))
        if 12 <= len(digits) <= 19 and total % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.findall("[0-9]", m[0])) <= 15]
    order = ("email", "ip", "card", "phone")
    return sorted(out, key=lambda s: (s[1], order.index(s[0])))


def test_op4_equals_the_patterns(spark, texts):
    got = {r.doc_id: r for r in queries.op4_pii(spark, DATA).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        spans = plain_spans(t)
        joined = ",".join(f"{k}:{a}:{z}" for k, a, z in spans)
        counts = collections.Counter(k for k, _, _ in spans)
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(counts[k] for k in ("email", "ip", "card", "phone"))
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(got[i].spans.split(","))


def test_op6_is_the_cheapest_plain_parse(spark, texts):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    sample = langid.train(docs, learnable())
    got = {r.doc_id: r for r in queries.op6_language_id(spark, DATA).collect()}
    assert got.keys() == texts.keys() and all(r.held_out == held_out(i) and 0 <= r.score <= 1 for i, r in got.items())
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in texts[i])) for i, r in got.items())

    def phrases(t, s):
        i, count, first = 0, 1, True
        while i < len(t):
            j = i + 1
            while j <= len(t) and t[i:j] in s:
                j += 1
            unknown = t[i : i + 1] not in s
            count, i, first = count + ((not first) or unknown), i + max(1, j - 1 - i), unknown
        return count

    import numpy as np

    for i in [i for i, t in texts.items() if 0 < len(t) < 900 and got[i].lang_pred != "und"][:12]:
        raw = np.frombuffer(texts[i].lower().encode(), np.uint8)
        folded = langid.folded(raw, np.array([0, len(raw)]))[0].tobytes()
        bits = {lang: phrases(folded, s) * math.log2(max(2, len(s))) for lang, s in sample.items()}
        assert got[i].lang_pred == min(sorted(bits), key=bits.get)


def test_op7_base_is_that_of_the_phrases(spark, texts):
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    got = {r.doc_id: r for r in queries.op7_license_scan(spark, DATA).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))
        places = [(j, label) for phrase, label in phrases.items() for p in [phrase.split()] for j in range(len(words)) if words[j : j + len(p)] == p]
        starts = [j for j, _ in places]
        labels = sorted({label for _, label in places})
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(labels) and set(labels) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def test_op10_places_the_tokenizer_s_ids(spark, texts):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = queries.op10_packing(spark, DATA).collect()
    by = collections.defaultdict(list)
    bins = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    assert by.keys() == texts.keys()
    for i, t in texts.items():
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want = [(k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by[i]) == want
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= math.ceil(sum(r.length for r in rows) / 4096) * 1.1 + 1

"""The audit against plain counting, and the automata against sorted lists."""

import random
import re
from collections import Counter

import numpy as np

from voltline.llm import divergence


def plain(rows, least, top):
    texts = [tuple(x or "" for x in r) for r in rows]
    words = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)), lang, source) for t, lang, source in texts]
    documents = Counter((lang, w) for ws, lang, _ in words for w in set(ws))
    kept = {}
    for (lang, w), n in documents.items():
        if n >= least:
            kept.setdefault(lang, []).append(w)
    count = Counter((lang, source, w) for ws, lang, source in words for w in ws if documents[lang, w] >= least)
    groups = {(lang, source) for _, lang, source in words}

    def shares(lang, n):
        total, v = sum(n.values()), len(kept[lang])
        return {w: 1 + 10**9 * (n[w] + 5) // (total + 5 * v) for w in kept[lang]}

    out, utf = [], lambda x: x.encode()
    for lang, source in groups:
        mine = sorted(kept.setdefault(lang, []), key=utf)
        p = {s: shares(lang, {w: count[lang, s, w] for w in mine}) for a, s in groups if a == lang} if mine else {}
        pairs = [(sum(abs(p[source][w] - p[s][w]) for w in mine), s) for a, s in groups if a == lang and s != source]
        out += [(lang, source, "pair", s, v, k + 1) for k, (v, s) in enumerate(sorted(pairs, key=lambda x: (-x[0], utf(x[1]))))]
        if mine:
            q = shares(lang, {w: sum(count[lang, s, w] for s in p) for w in mine})
            over = [(p[source][w] - q[w], w) for w in mine if count[lang, source, w] and p[source][w] > q[w]]
            out += [(lang, source, "term", w, v, k + 1) for k, (v, w) in enumerate(sorted(over, key=lambda x: (-x[0], utf(x[1])))[:top])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, *r, 7, "x") for i, r in enumerate(rows)], "doc_id int, text string, lang string, source string, n int, term string")


def found(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in df.collect())


def test_awkward_rows_match_counting(spark):
    rng = random.Random(3)
    words = ["The", "the", "été", "ÉTÉ", "中文", "a", "b", "ab", "abc", "b1c", "x_y", "\u0000z", "don't", "é" * 300]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 12))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "é", None, "s10"])) for _ in range(150)]
    rows += [(None, "en", "s1"), ("", "fr", "only"), ("rare words", "xx", "s1"), ("other", "xx", "s2"), ("a\nb\n" * 3000, "en", "s1")] + [rows[0]] * 5
    due = plain(rows, 5, 4)
    assert {r[2] for r in due} == {"pair", "term"} and any(r[0] == "xx" and r[4] == 0 for r in due)
    assert found(divergence.audit(table(spark, rows), least=5, top=4)) == due
    # small blocks, a pass for each block
    assert found(divergence.audit(table(spark, rows), least=5, top=4, block_terms=3, broadcast_bytes=1)) == due


def test_many_sources_and_terms_use_several_tiles(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SOURCES_AT_ONCE", 3)
    monkeypatch.setattr(divergence, "TERMS_AT_ONCE", 4)
    rng = random.Random(4)
    words = ["w" + "".join(rng.choices("abcd", k=3)) for _ in range(40)]
    rows = [(" ".join(rng.choices(words, k=8)), "en", f"s{rng.randint(0, 10)}") for _ in range(200)]
    assert found(divergence.audit(table(spark, rows), least=3, top=3)) == plain(rows, 3, 3)


def test_empty_table(spark):
    assert divergence.audit(table(spark, [])).count() == 0


def test_automaton_is_minimal_and_orders(spark):
    rng = random.Random(5)
    for _ in range(20):
        terms = sorted({bytes(rng.choices(b"abc\xc3\xa9", k=rng.randint(1, 6))) for _ in range(rng.randint(1, 120))})
        made = divergence.Transducer.of(iter(terms))
        asked = terms + [bytes(rng.choices(b"abc\xc3\xa9", k=rng.randint(1, 7))) for _ in range(60)]
        end = np.cumsum([len(t) for t in asked])
        place = {t: i for i, t in enumerate(terms)}
        assert made.ordinals(np.frombuffer(b"".join(asked), np.uint8), end - [len(t) for t in asked], end).tolist() == [place.get(t, -1) for t in asked]

        def right(state):
            out = {b""} if made.finals[state] else set()
            for k in np.flatnonzero(made.keys >> 8 == state):
                out |= {bytes([made.keys[k] & 255]) + r for r in right(int(made.targets[k]))}
            return frozenset(out)

        languages = [right(s) for s in range(len(made.finals))]
        assert len(set(languages)) == len(languages)


def test_long_texts_are_cut_between_terms():
    text = b"ab cd " * 1000 + b"x" * 500 + b" end"
    pieces = list(divergence.slices(text, 100))
    assert b"".join(pieces) == text and len(pieces) > 10
    assert [t for p in pieces for t in p.split()] == text.split()
    assert list(divergence.slices(b"")) == [b""]

import random
import time

from loomgraph.llm.common import WORD_RE
from loomgraph.llm.licences import TEMPLATES, Automaton, chains, choose, op5_licence_scan, scan

from .helpers import CLASHING, SCHEMA, frame, rows, words


def brute_matches(words_, texts, least):
    """Runs of equal words that can't be made longer at either end, for each template by itself."""
    out = set()
    for k, t in enumerate(texts):
        for e in range(1, len(words_) + 1):
            for te in range(1, len(t) + 1):
                n = 0
                while n < min(e, te) and words_[e - n - 1] == t[te - n - 1]:
                    n += 1
                if n >= least and not (e < len(words_) and te < len(t) and words_[e] == t[te]):
                    out.add((k, te, e, n))
    return out


def brute_finds(words_, texts, least, gap, cover):
    """Every chain of every template by recursion, then the finds one by one."""
    best = {}

    def grow(k, chain, score):
        te, de, n = chain[-1]
        if score >= cover * len(texts[k]):
            key = (k, de, te, n)
            begin = chain[0][1] - chain[0][2]
            best[key] = max(best.get(key, (0, 0)), (score, begin))
        for te2, de2, n2 in own[k]:
            over = max(0, de - (de2 - n2), te - (te2 - n2))
            if te2 > te and de2 > de and over < n2 and de2 - n2 - de <= gap and te2 - n2 - te <= gap:
                grow(k, [*chain, (te2, de2, n2)], score + n2 - over)

    own = {k: [] for k in range(len(texts))}
    for k, te, de, n in brute_matches(words_, texts, least):
        own[k].append((te, de, n))
    for k, matches in own.items():
        for m in matches:
            grow(k, [m], m[2])
    finds = {(k, begin, de, score) for (k, de, _, _), (score, begin) in best.items()}
    kept = []
    while finds:
        f = min(finds, key=lambda x: (len(texts[x[0]]) - 2 * x[3], -x[3] / len(texts[x[0]]), x))
        f = min((x for x in finds if (2 * x[3] - len(texts[x[0]]), x[3] / len(texts[x[0]])) == (2 * f[3] - len(texts[f[0]]), f[3] / len(texts[f[0]]))), key=lambda x: (x[0], x[1], x[2]))
        kept.append(f)
        finds = {x for x in finds if x[2] <= f[1] or f[2] <= x[1]}
    return sorted(kept, key=lambda x: x[1])


def test_matching_statistics_against_brute_force():
    rng = random.Random(7)
    for _ in range(150):
        texts = [[rng.randrange(3) for _ in range(rng.randrange(1, 9))] for _ in range(3)]
        words_ = [rng.randrange(4) for _ in range(25)]
        for least in (1, 3):
            got = Automaton(texts, least).matches(words_, least)
            assert set(got) == brute_matches(words_, texts, least) and len(got) == len(set(got))


def test_chains_and_overlaps_against_brute_force():
    rng = random.Random(11)
    some = 0
    for _ in range(400):
        base = [rng.randrange(6) for _ in range(12)]
        texts = [base[: rng.randrange(3, 7)], base, [rng.randrange(6) for _ in range(rng.randrange(2, 8))]]
        words_ = []
        while len(words_) < 24:
            t = rng.choice(texts)
            a = rng.randrange(len(t))
            words_ += t[a : a + rng.randrange(1, 8)] if rng.random() < 0.7 else [rng.randrange(6)]
        least, gap, cover = rng.choice((1, 2, 3)), rng.randrange(4), rng.choice((0.5, 0.7, 1.0))
        if least == 1:
            words_ = words_[:14]
        automaton = Automaton(texts, least)
        got = choose(chains(automaton.matches(words_, least), automaton.sizes, gap, cover), automaton.sizes)
        assert got == brute_finds(words_, texts, least, gap, cover)
        some += len(got)
    assert some > 300


PROBES = [
    ("Licensed under the Apache License, Version 2.0. Foo bar", "Apache-2.0 notice"),
    ("Licensed under the Apache License, Version 2.0. The software is nice", "Apache-2.0 notice"),
    ("Licensed under the Apache License, Version 2.0, the License file", "Apache-2.0 notice"),
    (TEMPLATES["BSD-2-Clause"] + " Neither of us", "BSD-2-Clause"),
    (TEMPLATES["BSD-3-Clause"] + " Neither of us", "BSD-3-Clause"),
]


def test_a_match_may_go_on_in_another_template(spark):
    got = rows(scan(frame(spark, [t for t, _ in PROBES])), "doc_id", "licence")
    assert got == [(i, name) for i, (_, name) in enumerate(PROBES)]


def test_a_long_text_of_one_phrase_is_quick():
    names = sorted(TEMPLATES)
    texts = [WORD_RE.findall(TEMPLATES[n].lower()) for n in names]
    automaton = Automaton(texts, 4)
    began = time.time()
    for phrase in ("of the gnu general public license", "the work " * 3, "version 2 of the license or at your option any later version"):
        words_ = phrase.split() * 2000
        choose(chains(automaton.matches(words_, 4), automaton.sizes, 20, 0.7), automaton.sizes)
    assert time.time() - began < 30


def test_chain_crosses_a_gap():
    text = list(range(20))
    found = [*range(8), 90, 91, *range(10, 20)]
    a = Automaton([text], 3)
    assert (0, 0, 20, 18) in chains(a.matches(found, 3), a.sizes, 5, 0.7)
    assert chains(a.matches(found, 3), a.sizes, 1, 0.7) == []


def test_every_template_is_found_in_noise(spark):
    rng = random.Random(3)
    texts, want = [], []
    for i, (name, text) in enumerate(sorted(TEMPLATES.items())):
        noise = " ".join(words(rng, 40))
        texts.append(f"{noise} {text.upper() if i % 2 else text} {noise}")
        want.append((i, name, len(noise) + 1))
    got = {(r.doc_id, r.licence, r.start) for r in scan(frame(spark, texts, **CLASHING)).collect()}
    assert got == set(want)


def test_damaged_text_and_fragments(spark):
    mit = TEMPLATES["MIT"].split()
    damaged = mit[:60] + ["INSERTED", "WORDS"] + mit[63:]
    df = frame(spark, [" ".join(damaged), " ".join(mit[:40]), "the software is provided as is", "this license and that license"])
    assert rows(scan(df), "doc_id", "licence") == [(0, "MIT")]


def test_nulls_empty_long_and_repeats(spark):
    notice = "Released under the MIT License."
    df = frame(spark, [None, "", (5, notice), (5, notice), (None, notice), "x " * 60_000 + notice + " y " + notice])
    assert rows(scan(df), "doc_id", "start", "finish") == sorted([(5, 0, 30), (5, 0, 30), (None, 0, 30), (5, 120_000, 120_030), (5, 120_034, 120_064)], key=repr)
    assert scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_finds_the_plain_notices(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op5_licence_scan(spark, sf_dir).collect()
    flat = {d: " ".join(WORD_RE.findall(t.lower())) for d, t in docs.items()}
    for name in ("MIT notice", "Apache-2.0 notice", "CC-BY-NC-4.0", "GPL-3.0 notice"):
        line = " ".join(WORD_RE.findall(TEMPLATES[name].lower()))
        assert {d for d, t in flat.items() if line in t} == {r.doc_id for r in got if r.licence == name}

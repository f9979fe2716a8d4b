"""The queries that SQL does not express, against plain Python over every row and pair."""

import hashlib
import random
import re

import numpy as np
import pytest
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F

from lexiloom.llm import bpe, decontaminate, simhash, toxicity
from lexiloom.llm.common import materialise

ODD_TEXTS = [None, "", " ", "a", "a b", "a b c", "A B C", "éİ \U0001f600 x", "\x00 \x1c\x1d y", "\t\n\x0b\x0c\r z q", "w" * 70_000, "spaces   and\n\nlines  ", "ab " * 5000]


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1.0) for i, t in enumerate(texts)], "doc_id long, text string, ids string, score double")


def test_op2_equals_the_tokenizer_library(spark):
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(30)
    texts = [*ODD_TEXTS, *("".join(rng.choice("ab cé1'\n中.<|>ndoftext") for _ in range(rng.randrange(200))) for _ in range(150)), "<|endoftext|>"]
    got = {r["doc_id"]: r for r in bpe.digests(documents(spark, texts)).collect()}
    for i, text in enumerate(texts):
        ids, r = library.encode_ordinary(text or ""), got[i]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.digests(documents(spark, texts).limit(0)).count() == 0


def plain_fingerprint(text, n):
    words = regex.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op9_equals_all_pairs(spark):
    rng = random.Random(31)
    base = [" ".join(rng.choice("abcdefgh") * 2 for _ in range(rng.choice([3, 40, 400]))) for _ in range(60)]
    texts = [*ODD_TEXTS, *base, *(f"{b} end" for b in base), *(b.upper() for b in base[:9]), *(b.replace(" ", "\t\n") for b in base[:9])]
    rows = materialise(simhash.fingerprints(documents(spark, texts), 3), "test-fingerprints")
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.classes(rows).collect()}
    prints = [plain_fingerprint(t, 3) for t in texts]
    assert [got[i][0] for i in range(len(texts))] == prints
    label = list(range(len(texts)))
    while (new := [min(label[j] for j in range(len(texts)) if (prints[i] ^ prints[j]).bit_count() <= 2) for i in range(len(texts))]) != label:
        label = new
    assert [got[i][1] for i in range(len(texts))] == label


def plain_features(text):
    """The distinct words and word beginnings, each by its own hash."""
    words = {w for w in re.findall(rb"[0-9a-z\x80-\xff]+", text.lower().encode())}
    return {x for w in words for x in toxicity.hashes(w)[1][:, 0].tolist()}


def test_op5_scores_equal_a_loop_over_words(spark):
    rng = random.Random(32)
    model = toxicity.fit([np.array([0, 1]), np.array([2])] * 3, np.array([1.0, 0.0] * 3), np.array(sorted(plain_features("bad worse good"))[:3]), [])
    model = toxicity.Model(np.array(sorted(plain_features("bad worse good naughty"))), rng.random() + np.arange(len(plain_features("bad worse good naughty"))) / 7.0, -1.5)
    weight = dict(zip(model.index.tolist(), model.weight.astype(np.float32).tolist(), strict=True))
    texts = [*ODD_TEXTS, *(" ".join(rng.choice(["bad", "BAD", "worse", "good", "naughty", "x", "badly", "é-bad"]) for _ in range(rng.randrange(30))) for _ in range(200))]
    got = toxicity.score(documents(spark, texts), model).collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "ids", "score"} and len(got) == len(texts)
    for r in got:
        z = -1.5 + sum(weight.get(f, 0) for f in plain_features(texts[r["doc_id"]] or ""))
        assert abs(r["score"] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-6
    assert toxicity.score(documents(spark, texts).limit(0), model).count() == 0


def test_op5_penalty_spares_neutral_mentions(spark):
    """Toxic texts name a group more often than others; with the penalty a neutral mention does not make a text toxic."""
    rng = random.Random(33)
    words, groups = [f"w{i}" for i in range(400)], ["muslim", "jewish", "gay", "black"]
    rows, labels = [], []
    for i in range(800):
        bad = i % 4 == 0
        signs = " ".join(rng.sample(["scumbag", "idiotic", "vermin", "filth"], 1)) if bad and rng.random() < 0.75 else ""
        named = f"{rng.choice(groups)} {rng.choice(words)}" if bad and rng.random() < 0.9 or rng.random() < 0.05 else ""
        rows.append((i, f"{' '.join(rng.choice(words) for _ in range(20))} {named} {signs}"))
        labels.append((i, int(bad)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    neutral = spark.createDataFrame([(i, f"{' '.join(rng.choice(words) for _ in range(20))} {groups[i % 4]} w1") for i in range(200)], "doc_id long, text string")
    rate, change = {}, {}
    for penalty in (0.0, toxicity.PENALTY):
        model = toxicity.train(docs, labels, penalty=penalty)
        rate[penalty] = toxicity.score(neutral, model).where(f"score >= {toxicity.THRESHOLD}").count() / 200
        plain = docs.where("doc_id % 4 <> 0")
        before = toxicity.score(plain, model).withColumnRenamed("score", "before")
        after = toxicity.score(toxicity.with_mentions(plain), model).select("doc_id", "score")
        change[penalty] = before.join(after, "doc_id").agg(F.avg(F.abs(F.col("score") - F.col("before")))).first()[0]
    assert rate[0.0] > 0.5 and rate[toxicity.PENALTY] < 0.2 * rate[0.0] and change[toxicity.PENALTY] < change[0.0]
    found = toxicity.cross_validate(docs.where("doc_id < 300"), labels, [0.0, 10.83], folds=2)
    assert set(found) == {0.0, 10.83} and all(0 < x[0] < 1 for x in found.values())


def plain_leaks(texts, items):
    """Every window of two cells against every piece of every item, by the common subsequence and the answer check."""
    block = decontaminate.make_block([(i, t, None) for i, t in items])
    words = {i: [block.vocabulary.get(w) for w in decontaminate._words((t or "").lower())] for i, t in enumerate(texts)}
    cells = {i: [ws[a : a + decontaminate.CELL] for a in range(0, len(ws), decontaminate.CELL)] for i, ws in words.items()}
    passages = [set(c) for cs in cells.values() for c in cs]
    held = {t: sum(t in p for p in passages) for t in range(len(block.vocabulary))}
    found = set()
    for p in block.pieces:
        if len(p.terms) < decontaminate.LEAST_WORDS:
            continue
        answer = sorted(set(p.terms), key=lambda t: (held[t], t))[: decontaminate.ANSWER_TERMS]
        for i, cs in cells.items():
            for a in range(len(cs)):
                inside = [t for t in (cs[a] + (cs[a + 1] if a + 1 < len(cs) else [])) if t is not None]
                common = decontaminate.common_subsequence(p.masks, inside, len(p.terms))
                enough = common >= decontaminate.LIKELY * len(p.terms) and len(set(inside) & set(answer)) >= decontaminate.ANSWER_SHARE * len(answer)
                if common >= decontaminate.SURE * len(p.terms) or enough:
                    found.add((i, block.ids[p.item]))
    return found


@pytest.mark.parametrize("seed", [34, 35])
def test_op4_finds_what_all_windows_hold(spark, seed):
    """Copies with up to half of their words changed, in texts that share their vocabulary; nothing beyond brute force is found."""
    rng = random.Random(seed)
    vocabulary = [f"t{int(rng.paretovariate(0.6)) % 3000}" for _ in range(20_000)]  # common and rare words
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(rng.randrange(12, 60)))) for i in range(60)]
    texts, planted = [" ".join(say(rng.randrange(0, 400))) for _ in range(150)], {}
    for i, text in items:
        for share in (0.0, 0.1, 0.2, 0.3, 0.4, 0.5):
            changed = [w if rng.random() >= share else f"new{rng.randrange(900)}" for w in text.split()]
            planted[len(texts), i] = share
            texts.append(" ".join(say(rng.randrange(100)) + changed + say(rng.randrange(100))))
    texts += [None, ""]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = plain_leaks(texts, items)
    assert got <= want and len(got) >= 0.9 * len(want), (len(got), len(want))
    by_share = {s: np.mean([k in got for k, x in planted.items() if x == s]) for s in sorted(set(planted.values()))}
    print("recall by share of changed words", by_share, "of brute force", len(got) / len(want))
    assert by_share[0.0] == 1 and by_share[0.1] >= 0.95 and by_share[0.2] >= 0.9

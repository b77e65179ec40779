"""Every stage of the pipeline against a plain version of it, on the rows that the stage before kept."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece

import corpus_pipeline
from vialume.llm import op6_mixing, op8_quality
from vialume.llm.store import materialize

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near_kept(docs):
    """The documents that stay of groups linked by four fifths of their runs of five words."""
    sets = {}
    for d in docs:
        w = WORD.findall((d["text"] or "").translate(FOLD))
        sets[d["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i for i in ids if find(i) == i}


def without_repeats(docs):
    """The texts without words of 20-word windows that started before."""
    first, out = {}, {}
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        w = WORD.findall(d["text"] or "")
        keep = [True] * len(w)
        for k in range(len(w) - 19):
            if first.setdefault(tuple(w[k : k + 20]), (d["doc_id"], k)) != (d["doc_id"], k):
                keep[k : k + 20] = [False] * 20
        out[d["doc_id"]] = (d["text"] or "") if all(keep) else " ".join(x for x, y in zip(w, keep) if y)
    return out


def test_stages_are_their_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, frames = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(materialize(stage(spark, frames[-1], SF), "test-pipeline"))
    assert all(f.columns == columns for f in frames[:-1])
    start, quality, near, cut, mixed, tokens = ([r.asDict() for r in f.collect()] for f in frames)

    kept = {r["doc_id"] for r in op8_quality.rules(docs).filter("kept").collect()}
    assert {d["doc_id"] for d in quality} == kept and len(quality) < len(start)
    assert all(d in start for d in quality)
    assert {d["doc_id"] for d in near} == near_kept(quality) and len(near) == len(near_kept(quality)) < len(quality)
    texts = without_repeats(near)
    assert {d["doc_id"]: d["text"] or "" for d in cut} == texts and all(d["n_chars"] == len(d["text"] or "") for d in cut)
    copies = {r["doc_id"]: r["copies"] for r in op6_mixing.mix(frames[3]).collect()}
    assert Counter(d["doc_id"] for d in mixed) == {i: n for i, n in copies.items() if n}
    size, taken, own = Counter(), Counter(), {d["doc_id"]: d for d in cut}
    for d in cut:
        size[d["source"]] += len(WORD.findall(d["text"] or ""))
    for d in mixed:
        assert d == own[d["doc_id"]]
        taken[d["source"]] += len(WORD.findall(d["text"] or ""))
    assert 0.9 * sum(size.values()) < sum(taken.values()) <= sum(size.values()) * 1.001

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(corpus_pipeline.PIECES))
    expected = defaultdict(int)
    for d in mixed:
        ids = sp.encode(d["text"] or "")
        expected[d["doc_id"], tuple(ids), hashlib.sha256(sp.decode(ids).encode()).hexdigest()] += 1
    got = Counter((r["doc_id"], tuple(r["token_ids"]), r["decoded_sha256"]) for r in tokens)
    assert got == expected and all(r["n_tokens"] == len(r["token_ids"]) for r in tokens)


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "token_ids", "decoded_sha256"] and out.count() > 0

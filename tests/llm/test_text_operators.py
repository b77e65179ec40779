"""Text operators against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from vialume.llm import op1_license, op2_warc, op3_jpeg, op4_sharding, op5_sentencepiece, op6_mixing, op7_substring, op8_quality, op9_token_counts, op10_jaccard
from vialume.llm.graph import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size int, rank long, copies int, variant string, n_words int, group int"


def words(text):
    return WORD.findall((text or "").encode())


def some_texts() -> list:
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdeéß日x#|") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, body = make(60), make(100)
    near = body.split()
    near[50] = "changed"
    return [
        None, "", " \n\t ", "a", "a b", "A  B", "a b c", body, body, " ".join(near), make(30) + " " + passage + " " + make(30), passage + "\n" + make(25), make(10) + " " + passage,
        "the end " * 200, "line one\nline one\n\nline one \nline two " + make(30), make(20000), "x" * 5000, "Released under the MIT License.\nAll rights reserved. " + make(40), body.upper(), "�  mixed \x00 nul " + make(20),
    ]


@pytest.fixture(scope="module")
def rows():
    texts = some_texts()
    out = [(k * 3 % 23, t, ["en", None, "de"][k % 3], [None, "s2", "s10", "é"][k % 4]) for k, t in enumerate(texts)]
    return [*out, out[7], out[7], out[10], (None, texts[7], None, None), (None, None, "en", "s2")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 2, 3, 4, "v", 5, 6) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_license(spark, docs, none):
    got = op1_license.scan(docs).toPandas()
    assert len(got) == docs.count() and op1_license.scan(none).count() == 0
    assert got[got.licenses == "MIT"].sentence_ids.tolist() == ["<mit-ref><reserved>"]
    full = " ".join(s.replace(" ", " ") + "." for i, s in op1_license.SENTENCES if i in ("bsd-intro", "bsd-source", "bsd-binary", "bsd-endorse"))
    two = spark.createDataFrame([(1, full + "\nLicensed under the Apache License, Version 2.0.", "x"), (2, full.rpartition("neither")[0], "x")], "doc_id long, text string, found string")
    assert sorted(map(tuple, op1_license.scan(two).select("doc_id", "licenses", "n_unmatched").collect())) == [(1, "BSD-3-Clause,Apache-2.0", 0), (2, "BSD-2-Clause", 0)]
    pdf = docs.toPandas()
    con = duckdb.connect()
    con.register("documents", pdf)
    theirs = con.sql(op1_license.scan_sql()).df()
    plain = lambda d: sorted(map(repr, d[sorted(d.columns)].astype(str).itertuples(index=False)))
    ours = got.assign(doc_id=got.doc_id.astype("Float64").astype(str))
    theirs = theirs.assign(doc_id=theirs.doc_id.astype("Float64").astype(str))
    assert plain(ours) == plain(theirs)


def _notices():
    """A notice of each licence of the rules, whole and then wrapped and commented in several ways."""
    first = {}
    for i, text in op1_license._TEXTS:
        first.setdefault(i, text)
    for name, run in op1_license.RULES:
        title = [first[i] for i in run if i == "mit-title"]  # a title has a line of its own
        text = " ".join(first[i] for i in run if i != "mit-title")
        yield name, "\n".join(["Some words before.\n", *title, "Copyright (c) 2019 Some Body", text, "\nSome words after it."])
        for mark in ("", "# ", " * ", "// "):
            lines = textwrap.wrap(text, 72 - len(mark))
            head = "/*\n" if mark == " * " else ""
            yield name, head + "\n".join(mark + line for line in [*title, "Copyright 2001, 2019 Some Body, Other Body", "", *lines, "", "More words here"])


def test_standard_notices_are_found(spark):
    notices = list(_notices())
    assert len({n for n, _ in notices}) >= 20
    got = {r["doc_id"]: r["licenses"] for r in op1_license.scan(spark.createDataFrame(list(enumerate(t for _, t in notices)), "doc_id long, text string")).collect()}
    assert [(n, got[k]) for k, (n, _) in enumerate(notices) if got[k] != n] == []


def test_licence_slots_and_unknown_sentences(spark):
    say = dict(op1_license._TEXTS)
    apart = " ".join([say["mit-grant"], "But one thing is odd.", say["mit-notice"], say["mit-asis"]])
    bsd = " ".join([say[i] for i in ("bsd-intro", "bsd-source", "bsd-binary")])
    texts = {
        1: (apart, ""), 2: (bsd + " Neither the name of Foo Bar, Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "BSD-2-Clause"),
        3: (bsd + " Neither the names of Foo Bar nor the names of other contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "BSD-3-Clause"),
        4: ("This file is licensed under the MIT license.", "MIT"), 5: ("# SPDX-License-Identifier: Apache-2.0\nimport x", "Apache-2.0"), 6: ("The code is distributed under the terms of the GNU General Public License, version 2. Enjoy.", "GPL-2.0-only"),
        7: ("// Licensed under the Apache License, Version 2.0 (the \"License\");\n// you may not use this file except in compliance with the License.\n// You may obtain a copy of the License at\n//\n//     http://www.apache.org/licenses/LICENSE-2.0\n//\n// Unless required by applicable law or agreed to in writing, software\n// distributed under the License is distributed on an \"AS IS\" BASIS,\n// WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\n// See the License for the specific language governing permissions and\n// limitations under the License.\n", "Apache-2.0"),
        8: ("We spoke of the MIT license and of copyright.", ""),
    }
    frame = spark.createDataFrame([(k, t) for k, (t, _) in texts.items()], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in op1_license.scan(frame).collect()}
    assert {k: r["licenses"] for k, r in rows.items()} == {k: n for k, (_, n) in texts.items()}
    assert rows[1]["sentence_ids"] == "<mit-grant><mit-notice><mit-asis>" and rows[1]["n_unmatched"] == 3
    con = duckdb.connect()
    con.register("documents", frame.toPandas())
    theirs = con.sql(op1_license.scan_sql()).df().set_index("doc_id").to_dict("index")
    assert all(theirs[k] == {c: v for c, v in r.asDict().items() if c != "doc_id"} for k, r in rows.items())


def test_warc(spark):
    html = ["<p>é</p>", None, "", "<p>é</p>", "x" * 100_000, "<p>é</p>", "new\r\n\r\nWARC-Type: revisit\r\n"]
    rows = [(k * 5 % 7, f"http://a/{k}\r\nX: y", h, "clash") for k, h in enumerate(html)] + [(None, None, "solo", "c"), (9, "u", "twin", "c"), (9, "u", "twin", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    path = op2_warc.write_archive(pages)
    assert spark.read.parquet(path + "/payloads").count() == len({h or "" for _, _, h, _ in rows})
    got = op2_warc.parse(op2_warc.restore(spark, path)).toPandas()
    largest = defaultdict(lambda: -1)
    for i, _, h, _ in rows:
        largest[h or ""] = max(largest[h or ""], -1 if i is None else i)
    expected = []
    for i, _, h, _ in rows:
        b, m = (h or "").encode(), largest[h or ""]
        first = i is None or i == m
        expected.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first else "revisit", None if first else m))
    ours = [(None if r.page_id != r.page_id else int(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, None if r.refers_to != r.refers_to else int(r.refers_to)) for r in got.itertuples()]
    assert sorted(map(repr, ours)) == sorted(map(repr, expected))
    record = op2_warc.restore(spark, path).filter(F.octet_length("payload") == 100_000).collect()[0]["record"]
    head, _, body = bytes(record).partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and b"Content-Length: 100000" in head and body == b"x" * 100_000 + b"\r\n\r\n"
    small = op2_warc.parse(op2_warc.restore(spark, op2_warc.write_archive(pages, least_bytes=50))).toPandas()
    assert (small.record_type == "response").all()
    assert op2_warc.parse(op2_warc.restore(spark, op2_warc.write_archive(pages.limit(0)))).count() == 0


def test_jpeg(docs, none, rows):
    got = op3_jpeg.media_features(op3_jpeg.store_texts(docs)).toPandas()
    expected = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        p = b + b" " * (max(1, -(-len(b) // 192)) * 192 - len(b))
        expected.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    ours = [(None if r.doc_id != r.doc_id else int(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got.itertuples()]
    assert sorted(map(repr, ours)) == sorted(map(repr, expected))
    assert op3_jpeg.media_features(op3_jpeg.store_texts(none)).count() == 0


def _scalar_jpeg(blocks: np.ndarray, across: int, parts: int, interval: int) -> bytes:
    """A plain encoder with run lengths, end-of-block codes and DC prediction; codes of all symbols are 8 bits, and differ by table."""
    order, bits, out = [0] if parts == 1 else [0, 0, 0, 0, 1, 2], "", bytearray()
    symbols = [s for s in range(256) if (s & 15) < 11]
    code = {s: format(k, "08b") for k, s in enumerate(symbols)}
    dc_code = {s: format(k, "04b") for k, s in enumerate(range(12))}
    table = bytes([0] * 7 + [len(symbols)] + [0] * 8) + bytes(symbols)
    dc_table = bytes([0] * 3 + [12] + [0] * 12) + bytes(range(12))

    def value(v):
        size = abs(v).bit_length()
        return size, format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else ""

    def flush():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        for k in range(0, len(bits), 8):
            byte = int(bits[k : k + 8], 2)
            out.append(byte)
            if byte == 255:
                out.append(0)
        bits = ""

    last = [0, 0, 0]
    mcus = len(blocks) // len(order)
    for m in range(mcus):
        if interval and m and m % interval == 0:
            flush()
            out += bytes([255, 0xD0 + (m // interval - 1) % 8])
            last = [0, 0, 0]
        for j, part in enumerate(order):
            b = blocks[m * len(order) + j]
            size, raw = value(int(b[0]) - last[part])
            last[part] = int(b[0])
            bits += dc_code[size] + raw
            run = 0
            for k in range(1, 64):
                if b[k] == 0:
                    run += 1
                    continue
                while run > 15:
                    bits += code[0xF0]
                    run -= 16
                size, raw = value(int(b[k]))
                bits += code[run << 4 | size] + raw
                run = 0
            if run:
                bits += code[0]
    flush()
    unit = 8 if parts == 1 else 16
    frame = b"\x08" + (mcus // across * unit).to_bytes(2, "big") + (across * unit).to_bytes(2, "big") + bytes([parts]) + (b"\x01\x11\x00" if parts == 1 else b"\x01\x22\x00\x02\x11\x00\x03\x11\x00")
    scan = bytes([parts]) + b"".join(bytes([k + 1, 0]) for k in range(parts)) + b"\x00\x3f\x00"
    m = op3_jpeg._marker
    return b"\xff\xd8" + m(0xE0, b"JFIF") + m(0xDB, b"\x00" + bytes([4] * 64)) + m(0xC0, frame) + m(0xC4, b"\x00" + dc_table) + m(0xC4, b"\x10" + table) + (m(0xDD, interval.to_bytes(2, "big")) if interval else b"") + m(0xDA, scan) + bytes(out) + b"\xff\xd9"


@pytest.mark.parametrize(("parts", "interval"), [(1, 0), (1, 3), (3, 0), (3, 2)])
def test_jpeg_reads_general_files(parts, interval):
    rng = np.random.default_rng(parts + interval)
    per = 1 if parts == 1 else 6
    b = rng.integers(-200, 200, (8 * per, 64)) * (rng.random((8 * per, 64)) < 0.1)
    b[0, 1:] = 0
    b[1, 1:] = 0
    b[1, 63] = 7
    frame, found = op3_jpeg.read_files([_scalar_jpeg(b, 4, parts, interval)])[0]
    assert (found == b).all() and frame.mcus == (4, 2)
    small = op3_jpeg.thumbnail(frame, found)
    assert small.shape == ((2, 4) if parts == 1 else (4, 8))
    assert small[0, 0] == np.clip((b[0, 0] * 4 + 4 >> 3) + 128, 0, 255)
    with pytest.raises(ValueError):
        op3_jpeg.parse_markers(b"no")


def test_large_image_is_padded():
    payload = np.frombuffer(b"\xff\x00ab" * (192 * 9000 // 4), dtype=np.uint8)
    f = op3_jpeg.encode_files(payload, np.array([len(payload)]))
    frame, c = op3_jpeg.read_files(f)[0]
    assert op3_jpeg.payload_of(frame, c) == payload.tobytes() and frame.height < 65536


def test_sharding(docs, none, rows, spark):
    for shards in (3, 40):
        got = op4_sharding.assign(docs, shards, 16).toPandas()
        n = got.groupby("shard").size()
        assert len(got) == len(rows) and n.max() - (n.min() if len(n) == shards else 0) <= 1
        assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    expected = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.size, r.text_crc32) for r in got.itertuples()) == expected
    assert op4_sharding.assign(none).count() == 0


def test_sharding_is_the_ring_walk():
    """Key by key clockwise: a shard takes what fits, and only overflow moves on."""
    rng, shards, vnodes = random.Random(1), 7, 16
    counts = {c: rng.randint(1, 30) for c in rng.sample(range(op4_sharding.CELLS), 200)}
    counts[5] = 4000
    pieces = op4_sharding.solve(counts, shards, vnodes)
    load = Counter()
    for c, lo, hi, s, first in pieces:
        assert first == load[s]
        load[s] += hi - lo
    total = sum(counts.values())
    assert sorted(load.values()) == sorted(total // shards + (s < total % shards) for s in range(shards))
    for c, n in counts.items():
        own = sorted(p[1:3] for p in pieces if p[0] == c)
        assert own[0][0] == 0 and own[-1][1] == n and all(a[1] == b[0] for a, b in zip(own, own[1:]))
    nodes = op4_sharding.ring(shards, vnodes)
    home = lambda c: next((s for at, s in nodes if at >= c), nodes[0][1])
    moved = sum(hi - lo for c, lo, hi, s, _ in pieces if s != home(c))
    natural = Counter()
    for c, n in counts.items():
        natural[home(c)] += n
    assert moved >= sum(max(0, n - total // shards - 1) for n in natural.values())


@pytest.mark.parametrize("seed", range(3))
def test_keys_go_where_the_walk_puts_them(seed):
    """Each key on its own: the next virtual node clockwise whose shard has room, in the order of rounds of overflow."""
    rng, shards, vnodes = random.Random(seed), 5, 8
    counts = {c: rng.randint(1, 9) for c in rng.sample(range(op4_sharding.CELLS), 60)}
    counts[rng.randrange(op4_sharding.CELLS)] = 300
    nodes, total = op4_sharding.ring(shards, vnodes), sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    walking = [((next((i for i, (at, _) in enumerate(nodes) if at >= c), 0)), c, r) for c in sorted(counts) for r in range(counts[c])]
    place = {}
    while walking:
        walking.sort()
        moved = []
        for node, c, r in walking:
            shard = nodes[node][1]
            if room[shard]:
                room[shard] -= 1
                place[c, r] = shard
            else:
                moved.append((node, c, r))
        walking = []
        for node, c, r in moved:
            k = (node + 1) % len(nodes)
            while not room[nodes[k][1]]:
                k = (k + 1) % len(nodes)
            walking.append((k, c, r))
    pieces = op4_sharding.solve(counts, shards, vnodes)
    assert {(c, r): s for c, lo, hi, s, _ in pieces for r in range(lo, hi)} == place


def test_ring_moves_few_keys():
    """One more shard, and one percent more rows, move little more than they must."""
    cells = Counter(int(hashlib.md5(str(k).encode()).hexdigest()[:4], 16) for k in range(60_000))
    where = lambda counts, shards: {(c, r): s for c, lo, hi, s, _ in op4_sharding.solve(counts, shards, 128) for r in range(lo, hi)}
    old, grown = where(cells, 40), where(cells, 41)
    assert sum(old[k] != grown[k] for k in old) / len(old) < 2 / 41
    more = cells + Counter(int(hashlib.md5(str(k).encode()).hexdigest()[:4], 16) for k in range(60_000, 60_600))
    later = where(more, 40)
    assert sum(old[k] != later[k] for k in old) / len(old) < 0.05
    nodes = op4_sharding.ring(40, 128)
    home = {c: next((s for at, s in nodes if at >= c), nodes[0][1]) for c in cells}
    assert sum(s != home[c] for (c, _), s in old.items()) / len(old) < 0.1


def test_sentencepiece(docs, none, rows):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = Counter(map(tuple, op5_sentencepiece.token_digests(docs, MODEL).collect()))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = Counter((i, len(ids := sp.encode(t or "")), sha(",".join(map(str, ids))), sha(sp.decode(ids))) for i, t, *_ in rows)
    assert got == expected and op5_sentencepiece.token_digests(none, MODEL).count() == 0
    back = op5_sentencepiece.decode(op5_sentencepiece.encode(docs, MODEL), MODEL)
    assert all((r["text"] or "") == r["decoded"] for r in back.collect())
    assert {r["doc_id"]: list(r["token_ids"]) for r in op5_sentencepiece.token_ids(docs.filter("doc_id = 9"), MODEL).collect()} == {9: sp.encode(rows[3][1])}


def test_sentencepiece_random_text():
    sp, table = sentencepiece.SentencePieceProcessor(model_file=MODEL), op5_sentencepiece.piece_table(MODEL)
    rng = random.Random(8)
    chars = [*list(table.chars)[:800], *"abcdefghijklmnopqrstuvwxyz       \n\t=-.▁\U0001f600͸" * 20]
    for _ in range(1500):
        t = "".join(rng.choice(chars) for _ in range(rng.randint(0, 120)))
        assert table.encode(t) == sp.encode(t) and table.decode(sp.encode(t)) == sp.decode(sp.encode(t))


def test_mixing(docs, none, rows, spark):
    got = op6_mixing.mix(docs).toPandas()
    assert len(got) == len(rows) and op6_mixing.mix(none).count() == 0
    size = Counter()
    for _, t, _, s in rows:
        size[s] += len(words(t))
    total, order = sum(size.values()), sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight, target = {s: k % 3 + 1 for k, s in enumerate(order)}, {}
    open_, left = set(order), float(total)
    while True:
        w = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / w > 3 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * size[s]
            open_.remove(s)
        left = total - sum(target.values())
    target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    assert sorted(set(np.round(got.target, 6))) == sorted(set(np.round(list(target.values()), 6)))
    assert (got.taken <= 3 * got["size"]).all()
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    theirs = con.sql(op6_mixing.mix_sql()).df()
    assert sorted(zip(got["size"], got.taken, got.target.round(6))) == sorted(zip(theirs["size"], theirs.taken, theirs.target.round(6)))
    assert op6_mixing.mixed(docs).columns == docs.columns
    again = op6_mixing.mix(docs.repartition(5)).toPandas()
    assert sorted(zip(got["size"], got.taken)) == sorted(zip(again["size"], again.taken))


@pytest.mark.parametrize("long_ones", [[60000], [30000, 29000], [9000, 8000, 7000, 6000]])
def test_mixing_goes_on_past_long_documents(spark, long_ones):
    """The words taken stay below the target by a small document at most, in both engines."""
    sizes = [("a", n) for n in [*long_ones, *[200] * 300]] + [("b", 200)] * 100 + [("c", 200)] * 100
    frame = spark.createDataFrame([(i, "w " * n, s) for i, (s, n) in enumerate(sizes)], "doc_id long, text string, source string")
    got = op6_mixing.mix(frame).toPandas()
    assert len(got) == len(sizes) and got.doc_id.nunique() == len(sizes)
    assert (got.taken == got.copies * got["size"]).all() and (got.position_ppm.notna() == (got.copies > 0)).all()
    for _, g in got.groupby(got.doc_id.map(lambda i: sizes[i][0])):
        assert 0 <= g.target.iloc[0] - g.taken.sum() <= 200 and g.copies.max() - g.copies.min() <= 1
    con = duckdb.connect()
    con.register("documents", frame.toPandas())
    theirs = con.sql(op6_mixing.mix_sql()).df()
    plain = lambda d: (sorted(d[["doc_id", "size", "taken", "copies"]].astype(int).itertuples(index=False)), dict(zip(d.doc_id, d.position_ppm.fillna(-1).astype(int))))
    assert plain(got) == plain(theirs)


def test_mixing_of_a_hot_source_with_repeated_ids_agrees_with_itself(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, 3]), " ".join(str(rng.randint(0, 9)) for _ in range(rng.choice([3, 3, 50]))), "hot" if k % 3 else f"s{k % 5}") for k in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    once, again = (Counter(map(tuple, op6_mixing.mixed(f).collect())) for f in (frame, frame.repartition(7)))
    assert once == again


def test_substring(docs, none, rows, spark):
    unique = {}
    for i, t, *_ in rows:
        if i is not None:
            unique.setdefault(i, t)
    frame = spark.createDataFrame([(i, t, "x") for i, t in unique.items()] + [(i, t, "y") for i, t in list(unique.items())[:3]], "doc_id long, text string, key string")
    for window in (20, 8):
        first, expected = {}, {}
        for i in sorted(unique):
            w = words(unique[i])
            keep = [True] * len(w)
            for k in range(len(w) - window + 1):
                if first.setdefault(tuple(w[k : k + window]), (i, k)) != (i, k):
                    keep[k : k + window] = [False] * window
            expected[i] = (len(w), keep.count(False), hashlib.sha256(b" ".join(x for x, y in zip(w, keep) if y)).hexdigest())
        if window == 20:
            got = op7_substring.digests(frame, window).collect()
            assert len(got) == frame.count() and all((r["n_words"], r["n_removed"], r["kept_sha256"]) == expected[r["doc_id"]] for r in got)
    assert op7_substring.digests(none).count() == 0 and op7_substring.digests(docs).count() == len(rows)
    out = op7_substring.dedup(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    kept = {r["doc_id"]: r["text"] for r in op7_substring.dedup(frame).collect()}
    lengthened = op7_substring.digests(frame, 20, most=-1)
    assert Counter(map(tuple, lengthened.collect())) == Counter(map(tuple, op7_substring.digests(frame, 20).collect()))
    for most in (None, -1):
        covered = defaultdict(set)
        for r in op7_substring.repeats(frame, 20, most).collect():
            own, before = words(unique[r["doc_id"]]), words(unique[r["earlier_doc_id"]])
            assert r["n_words"] >= 20 and (r["earlier_doc_id"], r["earlier_start"]) < (r["doc_id"], r["start"])
            assert own[r["start"] : r["start"] + r["n_words"]] == before[r["earlier_start"] : r["earlier_start"] + r["n_words"]]
            covered[r["doc_id"]].update(range(r["start"], r["start"] + r["n_words"]))
        assert {r["doc_id"]: r["n_removed"] for r in op7_substring.digests(frame, 20).collect()} == {i: len(covered[i]) for i in unique}
    assert all(kept[i] == t for i, t in unique.items() if len(words(t)) < 20)


def test_quality(docs, none, rows):
    got = op8_quality.rules(docs).toPandas()
    assert len(got) == len(rows) and op8_quality.rules(none).count() == 0
    expected = []
    for i, t, *_ in rows:
        w, seen, covered, lines, dup = words(t), defaultdict(list), set(), set(), 0
        for k in range(len(w) - 7):
            seen[tuple(w[k : k + 8])].append(k)
        for at in seen.values():
            if len(at) > 1:
                covered.update(j for k in at for j in range(k, k + 8))
        for line in (t or "").encode().split(b"\n"):
            dup += bool(WORD.search(line)) and line in lines
            lines.add(line)
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        expected.append((i, len(w), sum(len(x.decode()) for x in w), sum(c in op8_quality.SYMBOLS for c in t or ""), dup, len(covered), failed))
    ours = [(None if r.doc_id != r.doc_id else int(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got.itertuples()]
    assert sorted(map(repr, ours)) == sorted(map(repr, expected))
    assert not (got.kept & got.base_failed).any()
    assert op8_quality.filter_documents(docs).columns == docs.columns and op8_quality.filter_documents(docs).count() == got.kept.sum()


def test_quality_rejects_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    got = op8_quality.rules(docs).join(labels, "doc_id").filter("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.count(F.lit(1)).alias("n"))
    kept = {r["quality"]: r["kept"] for r in got.collect()}
    assert kept[0] < 0.5 and kept[1] > 0.95


def test_quality_bands_of_few_documents(spark):
    many = [("en", 1000 + k, 2.0 + k % 20 / 200) for k in range(100)] + [("de", 1000 + k, 1.5 + k % 20 / 200) for k in range(100)]
    lone = [("en", 200_000, 4.0), ("de", 200_000, 2.0), (None, 1000, 4.0), ("xx", 30, 4.0), ("xx", 30, 4.0), ("xx", 30, 4.1)]
    values = spark.createDataFrame(many + lone, "lang string, n_bytes long, value double")
    band = {(r["of_lang"], r["of_power"]): (r["low"], r["high"]) for r in op8_quality.bands(values).collect()}
    assert len(band) == len({(c, n.bit_length()) for c, n, _ in many + lone})
    for c, n, v in lone:
        assert v > band[c, n.bit_length() - 1][1]
    inside = [band[c, n.bit_length() - 1][0] <= v <= band[c, n.bit_length() - 1][1] for c, n, v in many]
    assert all(inside)


def _plain_kneser_ney(texts):
    """Log probability of each byte of each text: interpolated modified Kneser-Ney of order 3, by dictionaries."""
    grams = Counter()
    for t in texts:
        b = b"\n\n" + t
        grams.update(b[k : k + 3] for k in range(len(b) - 2))
    tables = {3: grams}
    for k in (2, 1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    def cut(table):
        n1, n2, n3, n4 = (sum(1 for c in table.values() if c == k) for k in (1, 2, 3, 4))
        if not (n1 and n2 and n3):
            return [0.0, 0.5, 0.5, 0.5]
        y = n1 / (n1 + 2 * n2)
        return [0.0, *(min(max(d, 0.0), k) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))]
    d = {k: cut(t) for k, t in tables.items()}
    total, left = defaultdict(float), defaultdict(float)
    for k, t in tables.items():
        for g, c in t.items():
            total[k, g[:-1]] += c
            left[k, g[:-1]] += d[k][min(c, 3)]
    def p(g):
        if not g:
            return 1 / 256
        k = len(g)
        c = tables[k].get(g, 0)
        lower = p(g[1:])
        if not total[k, g[:-1]]:
            return lower
        return (c - d[k][min(c, 3)]) / total[k, g[:-1]] + left[k, g[:-1]] / total[k, g[:-1]] * lower
    return [[np.log(p((b"\n\n" + t)[k : k + 3])) for k in range(len(t))] for t in texts]


@pytest.mark.parametrize("most", [4_000_000, 300])
def test_perplexity_is_the_plain_one_of_the_language(spark, monkeypatch, most):
    monkeypatch.setattr(op8_quality, "LEAST_CELL", 5)
    rng, rows = random.Random(9), []
    for lang, letters, n in (("en", "abcde  ", 9), ("de", "xyzö  ", 8), (None, "klm ", 6), ("r1", "qq ", 2), ("r2", "st ", 1), ("r3", "", 1)):
        rows += [(len(rows) + k, "".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) if letters else "", lang) for k in range(n)]
    frame = spark.createDataFrame([(i, t, c, i) for i, t, c in rows], "doc_id long, text string, lang string, variant long")
    got = {r["doc_id"]: r["value"] for r in op8_quality.scored(frame, most).collect()}
    again = {r["doc_id"]: r["value"] for r in op8_quality.scored(frame.repartition(7), most).collect()}
    assert got == again and len(got) == len(rows)
    expected, common = {}, dict(zip([i for i, _, _ in rows], _plain_kneser_ney([t.encode() for _, t, _ in rows])))
    for part in (["en"], ["de"], [None], ["r1", "r2", "r3"]):
        own = [(i, t.encode()) for i, t, c in rows if c in part]
        for (i, t), logs in zip(own, _plain_kneser_ney([t for _, t in own])):
            cut = range(0, len(t), op8_quality.SEGMENT)
            sums = [max(sum(logs[k : k + op8_quality.SEGMENT]), sum(common[i][k : k + op8_quality.SEGMENT])) for k in cut]
            expected[i] = -sum(sums) / len(t) if t else None
    for i, v in expected.items():
        assert (v is None and got[i] is None) or abs(got[i] - v) < 1e-5


def test_verdict_is_the_band_of_values(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = op8_quality.rules(docs).toPandas()
    full = docs.select("doc_id", "lang", F.octet_length(F.coalesce("text", F.lit(""))).alias("n")).toPandas().merge(rows, on="doc_id")
    full["power"], full["bin"] = np.floor(np.log2(np.maximum(full.n, 1))), np.floor(full.log_perplexity * op8_quality.BINS)
    some = full[full.log_perplexity.notna()]
    for r in some.itertuples():
        same = some[some.lang.isna()] if r.lang is None else some[some.lang == r.lang]
        pools = [same[same.power == r.power], same[abs(same.power - r.power) <= 1], same, some]
        pool = next((p for p in pools[:3] if len(p) >= op8_quality.LEAST_CELL), some)
        bins = np.sort(pool.bin.to_numpy())
        q1, q3 = (bins[int(np.ceil(len(bins) * q)) - 1] / op8_quality.BINS for q in (0.25, 0.75))
        span = max(q3 - q1, op8_quality.LEAST_RANGE)
        inside = q1 - span * op8_quality.REACH <= r.log_perplexity <= q3 + 1 / op8_quality.BINS + span * op8_quality.REACH_ABOVE
        assert r.kept == (inside and not r.base_failed)


def test_kneser_ney_is_a_distribution():
    texts = ["banana bandana", "bananas and bandits", "", "abracadabra"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    grams = op8_quality.packed_trigrams(data, np.cumsum([0, *map(len, texts)]))
    seen, n = np.unique(grams, return_counts=True)
    model = op8_quality.kneser_ney(seen, n)
    for context in (b"an", b"zz", b"qa", b"\n\n"):
        x = (np.uint32(context[0]) << 16 | np.uint32(context[1]) << 8) + np.arange(256, dtype=np.uint32)
        assert abs(np.exp(model.log_prob(x.astype(np.uint32))).sum() - 1) < 1e-5
    assert grams[0] == 10 << 16 | 10 << 8 | ord("b")


def test_token_counts(docs, none, rows):
    enc, length = op9_token_counts.encoding(RANKS, public_tokenizers.PATTERN)
    for rule in op9_token_counts.RULES:
        got = op9_token_counts.section_tokens(docs, RANKS, public_tokenizers.PATTERN, rule).toPandas()
        total = sum(len(enc.encode_ordinary(t)) for _, t, *_ in rows if t)
        assert abs(got.n_tokens.sum() - total) < 1e-6
    assert op9_token_counts.section_tokens(none, RANKS, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError):
        op9_token_counts.section_tokens(docs, RANKS, public_tokenizers.PATTERN, "other")
    ends, borders = np.array([3, 8, 10]), np.array([0, 4, 7, 10])
    assert op9_token_counts.allocate(ends, borders, "first")[0].tolist() == [2, 0, 1]
    assert op9_token_counts.allocate(ends, borders, "most")[0].tolist() == [1, 1, 1]
    assert np.allclose(op9_token_counts.allocate(ends, borders, "split")[0], [1.2, 0.6, 1.2])
    assert op9_token_counts.allocate(ends, borders, "first")[1].tolist() == [1, 0, 0]


@pytest.mark.parametrize("rule", ["first", "most", "split"])
def test_token_rows_are_plain_counts(docs, rows, rule):
    """Every row of the operator, from a walk over the tokens of each text."""
    enc, _ = op9_token_counts.encoding(RANKS, public_tokenizers.PATTERN)
    expected = Counter()
    for i, t, *_ in rows:
        lines, tokens, at = re.findall(rb"[^\n]*\n|[^\n]+", (t or "").encode()), enc.encode_ordinary(t or ""), 0
        owner = [k for k, line in enumerate(lines) for _ in line]
        got, crossing = [0.0] * len(lines), [0] * len(lines)
        for token in tokens:
            size = len(enc.decode_single_token_bytes(token))
            mine = Counter(owner[at : at + size])
            first = owner[at]
            crossing[first] += len(mine) > 1
            if rule == "first":
                got[first] += 1
            elif rule == "most":
                got[min(mine, key=lambda k: (-mine[k], k))] += 1
            else:
                for k, n in mine.items():
                    got[k] += n / size
            at += size
        begin = 0
        for k, line in enumerate(lines):
            end = begin + len(line.decode())
            expected[i, k, begin, end, round(got[k], 6), crossing[k], len(tokens)] += 1
            begin = end
    rows_ = op9_token_counts.section_tokens(docs, RANKS, public_tokenizers.PATTERN, rule).collect()
    assert Counter((r["doc_id"], r["section"], r["begin_char"], r["end_char"], round(r["n_tokens"], 6), r["n_crossing"], r["doc_tokens"]) for r in rows_) == expected


def test_tokens_of_fields(spark):
    """Fields as sections: each token of the joined document goes to the field of its first byte."""
    rows_ = [(1, "web", "Some text\nof lines", 7), (2, None, None, None), (3, "", "naïve — 日本語", 0), (3, "", "naïve — 日本語", 0), (None, "x" * 500, "y\n" * 3000, -1)]
    docs = spark.createDataFrame(rows_, "doc_id long, source string, text string, sizes int")
    enc, _ = op9_token_counts.encoding(RANKS, public_tokenizers.PATTERN)
    for fields in (["source", "text"], ["source", "text", "sizes"], ["text"], ["text", "source"]):
        expected = Counter()
        for row in rows_:
            own = dict(zip(docs.columns, row, strict=True))
            parts = [("" if own[c] is None else str(own[c])) + ("\n" if k + 1 < len(fields) else "") for k, c in enumerate(fields)]
            raw, tokens, at = [len(p.encode()) for p in parts], enc.encode_ordinary("".join(parts)), 0
            owner, got = [k for k, n in enumerate(raw) for _ in range(n)], Counter()
            for token in tokens:
                got[owner[at]] += 1
                at += len(enc.decode_single_token_bytes(token))
            begin = 0
            for k, p in enumerate(parts if sum(raw) else []):
                expected[own["doc_id"], k, begin, begin + len(p), got[k], len(tokens)] += 1
                begin += len(p)
        found = op9_token_counts.section_tokens(docs, RANKS, public_tokenizers.PATTERN, "first", fields).collect()
        assert Counter((r["doc_id"], r["section"], r["begin_char"], r["end_char"], r["n_tokens"], r["doc_tokens"]) for r in found) == expected


def _components(rows, k, percent):
    fold = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t, *_ in rows:
        w = [x.translate(fold) for x in words(t)]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                root[find(x)] = find(y)
    least = defaultdict(list)
    for x, r in enumerate(rows):
        if r[0] is not None:
            least[find(x)].append(r[0])
    return [(r[0], len(sets[x]), (min(least[find(x)]) if least[find(x)] else None) if sets[x] else r[0]) for x, r in enumerate(rows)]


@pytest.mark.parametrize(("percent", "few"), [(90, 16), (60, 2)])
def test_jaccard(docs, none, rows, spark, monkeypatch, percent, few):
    if few == 2:
        monkeypatch.setattr(op10_jaccard, "BLOCK", 3)
        monkeypatch.setattr(op10_jaccard, "UNIT_CLASSES", 2)
    rng, base = random.Random(6), [f"w{k}" for k in range(60)]
    family = [[w if rng.random() > 0.02 else "odd" for w in base] for _ in range(25)]
    more = [*rows, *((100 + k, " ".join(f), None, None) for k, f in enumerate(family))]
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t, *_ in more], "doc_id long, text string, n int, key int")
    got = op10_jaccard.linked(frame, 3, percent, few).collect()
    assert Counter(map(tuple, got)) == Counter(_components(more, 3, percent))
    if few != 2:
        assert op10_jaccard.linked(none).count() == 0
        kept = op10_jaccard.representatives(docs)
        assert kept.columns == docs.columns


def test_rows_with_null_and_repeated_ids_stay_apart(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 9) + str(rng.randint(0, 99)) for _ in range(60)) for _ in range(12)]
    rows = [(None, t) for t in texts[:5]] + [(7, t) for t in texts[5:9]] + [(8, texts[9]), (9, texts[9]), (None, texts[9]), (None, texts[0]), (7, ""), (7, None), (None, " ")]
    frame = spark.createDataFrame([(i, t, "s", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, source string, row long")
    kept = [(r["doc_id"], r["text"]) for r in op10_jaccard.representatives(frame).collect()]
    assert Counter(kept) == Counter([*rows[:9], (8, texts[9]), (7, ""), (7, None), (None, " ")])
    plan = op6_mixing.mix(frame.withColumn("source", F.when(F.col("row") % 2 == 0, "s").otherwise("t"))).toPandas()
    out = op6_mixing.mixed(frame.withColumn("source", F.when(F.col("row") % 2 == 0, "s").otherwise("t"))).toPandas()
    assert len(out) == plan.copies.sum()
    assert Counter(out.row.value_counts()) == Counter(plan.copies[plan.copies > 0])


def test_near_duplicates_of_the_pipeline(spark):
    rng = random.Random(3)
    rows = []
    for family in range(12):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
        for copy in range(3):
            w = list(base)
            for at in rng.sample(range(120), copy * rng.randint(1, 3)):
                w[at] = f"x{rng.randint(0, 10**6)}"
            rows.append((family * 10 + copy, " ".join(w), None, None))
    expected = {c for _, _, c in _components(rows, 5, 80)}
    assert len(expected) < len({c for _, _, c in _components(rows, 3, 90)})
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == expected


def test_small_partitions_share_tasks(spark):
    """Labels are written in few tasks, however many shuffle partitions there are."""
    held = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        found = components(spark.range(3000).selectExpr("id AS a", "id - id % 3 AS b").filter("a <> b"))
        files = len(found.inputFiles())
        roots = {r["node"]: r["root"] for r in found.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert roots == {n: n - n % 3 for n in range(3000)}
    assert files <= 8 * spark.sparkContext.defaultParallelism


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (103, 101), (7, 7), (100, 101)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 103: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 48, n, dtype=np.uint64)) for n in (10, 900, 2100, 4500, 5000, 20000)]
    sets += [np.union1d(sets[4][200:], sets[0]), np.union1d(sets[2][50:], sets[0])]

    def sketch(s):
        bits = int(op10_jaccard.sketch_bits(np.array([len(s)]))[0])
        parity = np.bincount((s >> np.uint64(12)).astype(np.int64) % bits, minlength=bits) & 1
        return np.packbits(parity.astype(np.uint8)).tobytes()

    x, y = np.triu_indices(len(sets), 1)
    apart = op10_jaccard.sketch_distances([sketch(s) for s in sets], x, y)
    assert all(d <= len(np.setxor1d(sets[i], sets[j])) for d, i, j in zip(apart, x, y))
    far = dict(zip(zip(x.tolist(), y.tolist()), apart.tolist()))
    assert far[3, 4] > 526 and far[4, 6] <= 210


def thue_morse(order: int, letters: str) -> str:
    out = letters[0]
    for _ in range(order):
        out += out.translate(str.maketrans(letters, letters[::-1]))
    return out


@pytest.mark.parametrize("order", [10, 12])
def test_structured_words_have_their_own_hashes(spark, order):
    """Words whose polynomial hashes modulo a power of two are equal are still told apart everywhere."""
    a, b = thue_morse(order, "ab"), thue_morse(order, "ba")
    sp, table = sentencepiece.SentencePieceProcessor(model_file=MODEL), op5_sentencepiece.piece_table(MODEL)
    data = np.frombuffer((a + b + a).encode(), np.uint8)
    at = np.array([0, len(a), 2 * len(a), 3 * len(a)])
    got = [(n, ids.decode(), text.decode()) for n, ids, text in table.described(data, at)]
    assert got == [(len(i := sp.encode(t)), ",".join(map(str, i)), t) for t in (a, b, a)]
    head = " ".join(f"w{k}" for k in range(19))
    frame = spark.createDataFrame([(1, f"{head} {a}"), (2, f"{head} {b}")], "doc_id long, text string")
    assert [r["n_removed"] for r in op7_substring.digests(frame).collect()] == [0, 0]
    frame = spark.createDataFrame([(1, f"{a} z z"), (2, f"{b} z z")], "doc_id long, text string")
    assert sorted(r["component_id"] for r in op10_jaccard.linked(frame).collect()) == [1, 2]


def test_equal_hashes_are_told_apart_by_bytes(monkeypatch):
    monkeypatch.setattr(op5_sentencepiece, "span_hashes", lambda data, begin, end, lane, read: (end - begin).astype(np.uint64) % 3)
    data = np.frombuffer(b"abcabdabcxyzxy" + b"q" * 300 + b"q" * 299 + b"r", np.uint8)
    begin, end = np.array([0, 3, 6, 9, 12, 14, 314]), np.array([3, 6, 9, 12, 14, 314, 614])
    code, first = op5_sentencepiece.distinct_spans(data, begin, end)
    raw = data.tobytes()
    texts = [raw[i:j] for i, j in zip(begin, end)]
    assert all((code[i] == code[j]) == (texts[i] == texts[j]) for i in range(7) for j in range(7))
    assert all(texts[first[c]] == t for c, t in zip(code, texts))


CLASHES = ["key", "variant", "kept_id", "kept_variant", "kept_key", "row_key", "mix_row", "mix_at", "mix_copies", "mix_copy", "of_row", "n_words", "n_removed", "repeats", "sizes", "of", "of_variant", "component", "group", "n", "no", "label", "place", "size", "copies", "taken"]


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_clashing_columns_and_take_empty_tables(spark, rows, stage):
    _, run = corpus_pipeline.STAGES[stage]
    names = ["doc_id", "text", "lang", "source", "n_chars", *CLASHES]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
    frame = spark.createDataFrame([(*r, len(r[1] or ""), *CLASHES) for r in rows], schema)
    out = run(spark, frame, "")
    assert out.columns == names
    got = out.collect()
    assert got and all(tuple(r)[5:] == tuple(CLASHES) for r in got)
    assert run(spark, frame.limit(0), "").count() == 0


def test_families_larger_than_a_block(spark, monkeypatch):
    """Frequent n-grams and large components, with classes that no pivot reaches."""
    monkeypatch.setattr(op10_jaccard, "BLOCK", 6)
    monkeypatch.setattr(op10_jaccard, "UNIT_CLASSES", 5)
    rng, rows = random.Random(12), []
    for family in range(2):
        base = [f"f{family}w{k}" for k in range(50)]
        for copy in range(40):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(50)] = f"x{rng.randint(0, 10**6)}"
            rows.append((family * 100 + copy, " ".join(w), None, None))
        chain = [f"c{family}w{k}" for k in range(60)]
        rows += [(1000 + family * 100 + k, " ".join(chain[k : k + 40]), None, None) for k in range(20)]
    frame = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = op10_jaccard.linked(frame, 3, 80).collect()
    assert Counter(map(tuple, got)) == Counter(_components(rows, 3, 80))

"""Each operator against brute force over rows with every awkward case."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from fathom.llm import jpeg, line_dedup, ngram_join, order_minhash, packing, substring_rlz, substring_suffix
from fathom.llm.common import Words, sliding_min
from fathom.llm.suffix_sort import blind_trie, common_prefix, deep_shallow

WORD = re.compile(r"[^\x20\x09-\x0d]+")
low = lambda i: -(2**63) if i is None else i
sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def distinct(texts):
    """Rows of equal id and text are one document."""
    return sorted({(low(i), t or "") for i, t in texts})


def compare(found, want, texts):
    """found: rows with doc_id; want: {(id, text): values}; the multisets must agree."""
    assert Counter(found) == Counter((i, *want[low(i), t or ""]) for i, t in texts)


def test_order_minhash(docs, texts, empty):
    ordered = sorted(texts, key=lambda r: (low(r[0]),))
    rows = order_minhash.compare_with_edited(docs, run_docs=4).collect()
    assert len(rows) == len(texts) and order_minhash.compare_with_edited(empty).count() == 0
    assert sorted(low(r["doc_id"]) for r in rows) == [low(i) for i, _ in ordered]
    by = defaultdict(set)
    for i, t in texts:
        by[low(i)].add(t or "")
    prints = {order_minhash.to_hex(order_minhash.fingerprint(t or "")) for _, t in texts}
    ids = sorted(by)
    for r in rows:
        i = low(r["doc_id"])
        assert r["fingerprint"] in prints
        if len(by[i]) == 1 and Counter(low(j) for j, _ in texts)[i] == 1:
            (text,) = by[i]
            nexts = by[ids[(ids.index(i) + 1) % len(ids)]]
            edited = {text[: len(text) - len(text) // 2] + n[: len(text) // 2] for n in nexts}
            assert r["edited_sha256"] in {sha(e) for e in edited} and r["n_chars"] == len(text)
            assert r["near_edited"] in {order_minhash.likeness(order_minhash.fingerprint(text), order_minhash.fingerprint(e)) for e in edited}


@pytest.mark.parametrize("text", ["a", "abcabcabc" * 9, "é😀x" * 50, "one two three four five six seven"])
def test_order_minhash_selection(text):
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kmers = order_minhash.numbered_kmers(codes, 5)
    assert len(kmers) == max(1, len(text) - 4)
    grams = [text[i : i + 5] for i in range(len(kmers))]
    assert len(set(kmers.tolist())) == len(grams)  # occurrence numbers make repeats distinct
    reverse = order_minhash.fingerprint(text[::-1])
    assert len(text) < 12 or order_minhash.likeness(order_minhash.fingerprint(text), reverse) < 1


def test_jpeg_round_trip(docs, texts, empty):
    want = {}
    for i, t in distinct(texts):
        raw = t.encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        want[i, t] = (len(raw), len(payload), sha(payload), zlib.crc32(payload[-64:]))
    rows = jpeg.store_texts(docs).collect()
    compare([(r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows], want, texts)
    assert jpeg.store_texts(empty).count() == 0
    for r in rows:
        assert len(r["media"]) == r["media_bytes"] and sha(bytes(r["media"])) == r["media_sha256"]
    files = docs.sparkSession.createDataFrame([(1, bytearray(rows[0]["media"])), (2, bytearray(b"junk")), (3, None)], "id long, file binary")
    seen = {r["doc_id"]: r for r in jpeg.image_features(files, "id", "file").collect()}
    assert f"{seen[1]['width']}x{seen[1]['height']}:{seen[1]['thumb_hash']}" == rows[0]["feature"] and seen[2]["error"] and seen[3]["error"]


def test_jpeg_general_stream():
    """Runs, end of block, DC prediction over a restart interval and two ways of decoding."""
    codes_dc, codes_ac = jpeg.canonical({s: 4 for s in range(12)}), jpeg.canonical({r << 4 | s: 8 for r in range(16) for s in range(1, 11)} | {0: 8, 0xF0: 8})
    rng = np.random.default_rng(1)
    blocks = np.where(rng.random((40, 64)) < 0.15, rng.integers(-500, 500, (40, 64)), 0)

    def put(bits, value, size):
        if size:
            bits.append(f"{value if value > 0 else value + (1 << size) - 1:0{size}b}")

    def scan(interval):
        out, before = b"", 0
        for at in range(0, 40, interval):
            bits, before = [], 0
            for block in blocks[at : at + interval]:
                diff = int(block[0]) - before
                before, size = int(block[0]), abs(diff).bit_length()
                bits.append(f"{codes_dc[size][0]:04b}")
                put(bits, diff, size)
                run = 0
                for v in block[1:]:
                    if v == 0:
                        run += 1
                        continue
                    while run > 15:
                        bits.append(f"{codes_ac[0xF0][0]:08b}")
                        run -= 16
                    size = abs(int(v)).bit_length()
                    bits.append(f"{codes_ac[run << 4 | size][0]:08b}")
                    put(bits, int(v), size)
                    run = 0
                if run:
                    bits.append(f"{codes_ac[0][0]:08b}")
            joined = "".join(bits)
            joined += "1" * (-len(joined) % 8)
            raw = int(joined, 2).to_bytes(len(joined) // 8, "big").replace(b"\xff", b"\xff\x00")
            out += raw + (bytes([0xFF, 0xD0 + at // interval % 8]) if at + interval < 40 else b"")
        return out

    for interval in (1, 40):
        head = b"\xff\xd8" + b"\xff\xdb\x00\x43\x00" + bytes([3] * 64) + jpeg._dht(0, {s: 4 for s in range(12)}) + jpeg._dht(16, {k: 8 for k in codes_ac}) + b"\xff\xdd\x00\x04" + interval.to_bytes(2, "big")
        head += b"\xff\xc0\x00\x0b\x08\x00\x28\x00\x40\x01\x01\x11\x00" + b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00"
        image, found = jpeg.decode([head + scan(interval) + b"\xff\xd9"])[0]
        assert (found[:, 0] == blocks).all() and (image.width, image.height) == (64, 40)
        assert jpeg.thumbnail(image, found).shape == (5, 8)


def test_packing(docs, texts, empty):
    from tokenizers import Tokenizer

    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    ids = {t or "": [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for _, t in texts}
    rows = packing.pack(docs, window=256, shard_docs=9).collect()
    assert packing.pack(empty).count() == 0
    per = defaultdict(list)
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        per[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in per.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert Counter((r["doc_id"], r["start"], r["doc_tokens"], tuple(r["ids"])) for r in rows) == Counter((i, s, len(ids[t or ""]), tuple(ids[t or ""][s : s + 256])) for i, t in texts for s in range(0, len(ids[t or ""]), 256))


@pytest.mark.parametrize("text", ["", "<|endoftext|> a", "\x85  \xa0x \t\n\n y  ", "don't I'LL 123٤ ﬁ \U0001f469‍\U0001f4bb", "a" * 3000, " " * 500 + "x", "é̀ 가"])
def test_fast_encoder_gives_the_tokenizers_ids(text):
    from tokenizers import Tokenizer

    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    assert packing.encoder()(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_knows_added_tokens(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mark = "<|endoftext|>"
    texts = [f"a {mark} b", mark, mark * 3, f"{mark}\n\n  é😀 x{mark}y ", f"  {mark}  don't", "<|endoftext |> <|endoftext|", f"<|{mark}|>", "plain", ""]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: list(r["ids"]) for r in rows} == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    assert next(r for r in rows if r["doc_id"] == 0)["ids"] == [64, 220, 50256, 275, 1]


def test_best_fit_decreasing_is_best_fit():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 101, 700)
    sequence, offset = packing.best_fit_decreasing(lengths, 100)
    room: list[int] = []
    for i in np.argsort(-lengths, kind="stable"):
        open_ = [r for r in room if r >= lengths[i]]
        k = int(sequence[i])
        if k == len(room):
            assert not open_
            room.append(100)
        else:
            assert room[k] == min(open_)
        assert offset[i] == 100 - room[k]
        room[k] -= lengths[i]


def test_rlz(docs, texts, empty):
    seen, want = set(), {}
    for i, t in distinct(texts):
        words = WORD.findall(t)
        gone = np.zeros(len(words), bool)
        for j in range(len(words) - 19):
            window = tuple(words[j : j + 20])
            if window in seen:
                gone[j : j + 20] = True
            seen.add(window)
        want[i, t] = (len(words), int(gone.sum()), sha(" ".join(w for w, g in zip(words, gone, strict=True) if not g)))
    # ties of one id go by the text's hash, so both orders of the two texts of id 43 are fine: they share no window
    compare([(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_rlz.remove_repeats(docs).collect()], want, texts)
    assert substring_rlz.remove_repeats(empty).count() == 0


def test_suffix(docs, texts, empty):
    window, count, want = 90, Counter(), {}
    for _, t in distinct(texts):
        raw = t.encode()
        count.update(raw[j : j + window] for j in range(len(raw) - window + 1))
    for i, t in distinct(texts):
        raw = t.encode()
        gone = np.zeros(len(raw) + 1, np.int8)
        for j in range(len(raw) - window + 1):
            if count[raw[j : j + window]] > 1:
                gone[j : j + window] = 1
        want[i, t] = (len(raw), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()), sha(np.frombuffer(raw, np.uint8)[gone[:-1] == 0].tobytes()))
    for hot in (2000, 1):
        from fathom.llm import repeats

        repeats.HOT, before = hot, repeats.HOT
        try:
            rows = substring_suffix.remove_repeats(docs, window=window, gram=16, chunk=16).collect()
        finally:
            repeats.HOT = before
        compare([(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows], want, texts)
    assert substring_suffix.remove_repeats(empty).count() == 0


def test_deep_shallow_sorts():
    rng = np.random.default_rng(2)
    text = np.concatenate([rng.integers(97, 99, 900).astype(np.uint8), np.tile(rng.integers(97, 99, 150).astype(np.uint8), 4), np.zeros(100, np.uint8)])
    start = np.arange(len(text) - 100)
    group = start % 3
    order, equal = deep_shallow(text, start, group, 80)
    raw = text.tobytes()
    keys = [(int(group[i]), raw[start[i] : start[i] + 80]) for i in order]
    assert keys == sorted(keys)
    assert equal.tolist() == [False] + [a == b for a, b in zip(keys, keys[1:], strict=False)]
    words = [raw[i : i + 80] for i in range(0, 1400, 7)]
    found, shared = blind_trie(words)
    assert [words[i] for i in found] == sorted(words)
    assert all(common_prefix(words[a], words[b]) == s for a, b, s in zip(found, found[1:], shared[1:], strict=False))


def line_oracle(texts):
    lines, where = {}, []
    for i, t in distinct(texts):
        for n, line in enumerate(t.split("\n")):
            if line.strip(" \t\r"):
                where.append((i, t, n, line))
                lines.setdefault(line, {line[j : j + 8] for j in range(max(1, len(line) - 7))})
    names, parent = list(lines), {line: line for line in lines}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(names):
        for b in names[k + 1 :]:
            common = len(lines[a] & lines[b])
            if 100 * common >= 80 * (len(lines[a]) + len(lines[b]) - common):
                parent[root(a)] = root(b)
    groups = defaultdict(list)
    for i, t, n, line in where:
        groups[root(line)].append((i, t, n))
    return groups


def test_lines(docs, texts, empty):
    rows = line_dedup.dedup(docs).collect()
    groups = line_oracle(texts)
    assert len(rows) == len(texts) and line_dedup.dedup(empty).count() == 0
    gone = Counter()
    for members in groups.values():
        first = min(members)
        for i, t, _ in members[1:] if members[0] == first else [m for m in members if m != first]:
            gone[i, t] += 1
    for r in rows:
        options = {gone[low(i), t or ""] for i, t in texts if low(i) == low(r["doc_id"])}
        assert r["n_removed"] in options, r
    kept = line_dedup.rewrite(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert {(r["doc_id"], r["text"]) for r in kept.where("doc_id in (40, 41, 42)").collect()} == {(40, None), (41, ""), (42, "   \n\t ")}


def test_ngram_join(docs, texts, empty):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    nodes = distinct(texts)
    sets = []
    for _, t in nodes:
        words = WORD.findall(t.translate(lower))
        sets.append({tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))} if words else set())
    parent = list(range(len(nodes)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(nodes)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    want = {node: (len(sets[k]), None if nodes[root(k)][0] == low(None) else nodes[root(k)][0]) for k, node in enumerate(nodes)}
    compare([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.component_ids(docs).collect()], want, texts)
    assert ngram_join.component_ids(empty).count() == 0
    kept = ngram_join.keep_first(docs)
    assert kept.columns == docs.columns
    roots = {nodes[root(k)] for k in range(len(nodes))}
    assert {(low(r["doc_id"]), r["text"] or "") for r in kept.collect()} <= {n for n in nodes} and kept.count() == sum((low(i), t or "") in roots for i, t in texts) - sum(0 for _ in ())


def test_ngram_join_large_groups(spark):
    """Chains of near copies under shared tokens: leaders miss links that blocks must find."""
    base = [f"w{i}" for i in range(60)]
    rows, ids = [], 0
    for step in range(0, 50, 2):
        words = list(base)
        for k in range(step // 2):
            words[59 - k] = f"z{k}"
        rows += [(ids + n, " ".join(words) + (" tail" if n else "")) for n in range(2)]
        ids += 2
    found = {r["doc_id"]: r["component_id"] for r in ngram_join.component_ids(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    label = {i: i for i in sets}
    for a in sorted(sets):
        for b in sets:
            common = len(sets[a] & sets[b])
            if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((label[a], label[b]))
                label = {k: x if v == y else v for k, v in label.items()}
    assert found == label


def test_words_and_minima():
    import pyarrow as pa

    words = Words(pa.array(["a b c", None, "", " \x0bA "]), lower=True)
    assert np.diff(words.first).tolist() == [2, 0, 0, 1] and words.hash[0] == words.hash[2]
    keys = np.random.default_rng(0).integers(0, 99, 200).astype(np.uint64)
    assert sliding_min(keys, 13).tolist() == [min(keys[i : i + 13]) for i in range(188)]

"""Token files, cross-tokenizer alignment and collocations against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from docloom.llm import collocations, cross_tokens, token_files
from docloom.llm.perfect_hash import PerfectHash

DOCS = "text string, extra string, doc_id long, lang string"
BITS = ["a", "b", "the", "The", " ", "  ", "\n", "\t", " ", " ", "é", "é", "́", "Σ", "ΑΣ", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<unk>", "<0x0A>", "1", "12", ".", ",", "'s", "DON'T", "▁", "　", "\x1c", "\x00", "\x85", "漢", "😀", "‍", "İ", "ﬁ", "\r\n", "﻿", "²", "_", "ß", "’", "x" * 70]


def nasty(n, seed=1):
    r = random.Random(seed)
    return ["", None, " ", "x" * 30000, *("".join(r.choice(BITS) for _ in range(r.randint(0, 14))) for _ in range(n))]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


# 11 token files -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def expected_ids(library, rows):
    """(doc_id, start, n_tokens, crc) in ascending order of keys, nulls first; equal keys in any order of texts."""
    out = collections.defaultdict(list)
    for text, _, doc_id, _ in rows:
        out[doc_id].append(np.asarray([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4"))
    return out


def test_token_files_equal_library(spark, library, tmp_path):
    texts = nasty(300)
    rows = [(t, "x", None if i % 50 == 7 else (i * 37) % 211, "en") for i, t in enumerate(texts)]
    files = token_files.write(frame(spark, rows).repartition(5), f"file://{tmp_path}/f", shard_bytes=1500, bucket_keys=20)
    assert len(files.manifest["shards"]) > 5 and files.manifest["buckets"] > 5
    keys = spark.createDataFrame([(i,) for i in [None, *range(211), 10**12, 10**12 + 1, 5, 5]], "doc_id long")
    found = files.read(keys).collect()
    expected = expected_ids(library, rows)
    own = collections.defaultdict(list)
    for r in found:
        own[r["doc_id"]].append(r)
    assert own.keys() == expected.keys()
    start = 0
    for key in sorted(expected, key=lambda k: (k is not None, k or 0)):
        assert sorted(x.tolist() for x in expected[key]) == sorted(r["ids"] for r in own[key])
        for r in sorted(own[key], key=lambda r: r["start"]):
            assert r["start"] == start
            assert r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.asarray(r["ids"], "<u4").tobytes())
            start += r["n_tokens"]
    assert start == files.manifest["tokens"]
    again = token_files.TokenFiles(f"file://{tmp_path}/f").read(keys, ids=False)
    assert sorted(map(tuple, again.collect()), key=repr) == sorted((tuple(r)[:4] for r in found), key=repr)


def test_token_files_of_nothing(spark, tmp_path):
    files = token_files.write(frame(spark, []), f"file://{tmp_path}/f")
    assert files.read(spark.createDataFrame([(1,)], "doc_id long")).collect() == []
    assert files.manifest["shards"] == []


def test_one_key_of_most_rows_in_many_shards(spark, library, tmp_path):
    rows = [(f"word{i % 40} text", "x", 3 if i % 3 else i, "en") for i in range(600)]
    files = token_files.write(frame(spark, rows), f"file://{tmp_path}/f", shard_bytes=400)
    found = files.read(spark.createDataFrame([(3,)], "doc_id long")).collect()
    own = expected_ids(library, rows)[3]
    assert sorted(r["ids"] for r in found) == sorted(x.tolist() for x in own)


def test_string_keys(spark, tmp_path):
    docs = spark.createDataFrame([("b", "one two"), ("a", "three"), (None, "four")], "name string, text string")
    files = token_files.write(docs, f"file://{tmp_path}/f", key="name")
    rows = files.read(docs, key="name", ids=False).orderBy("start").collect()
    assert [r["name"] for r in rows] == [None, "a", "b"]


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_perfect_hash_is_minimal(n):
    r = np.random.default_rng(n)
    h1, h2 = (r.integers(0, 2**63, n, dtype=np.uint64) for _ in range(2))
    h1[: n // 3] = 7  # equal first hashes
    table = PerfectHash.build(h1, h2)
    assert sorted(table.slots(h1, h2).tolist()) == list(range(n))


# 12 alignment -----------------------------------------------------------------------------------


def brute_alignment(texts):
    left = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in keep)}
    own, held = [], collections.Counter()
    for text in texts:
        a, b = left.encode(" " + (text or ""), add_special_tokens=False).ids, right.encode(text or "")
        bytes_a = [bytes(back[c] for c in left.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(right.id_to_piece, b)]
        raw = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            own.append(None)
            continue
        spans = []
        for parts in (bytes_a, bytes_b):
            at, out = 0, []
            for p in parts:
                out.append((at, at + len(p)))
                at += len(p)
            spans.append(out)
        links, j = [], 0
        for i, (s, e) in enumerate(spans[0]):
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(b) and spans[1][k][0] < e:
                links.append((a[i], b[k]))
                k += 1
        both = {e for _, e in spans[0]} & {e for _, e in spans[1]}
        groups = [([], [])]
        events = sorted([(e, 0, x) for (_, e), x in zip(spans[0], a, strict=True)] + [(e, 1, x) for (_, e), x in zip(spans[1], b, strict=True)], key=lambda x: x[:2])
        for n, (e, side, x) in enumerate(events):
            groups[-1][side].append(x)
            if e in both and (n + 1 == len(events) or events[n + 1][0] > e):
                groups.append(([], []))
        groups.pop()
        own.append((len(a), len(b), links, groups))
        held.update(set(links))
    most = collections.defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for x in own:
        if x is None:
            out.append((0, 0, 0, 0, 0, 0, "", 0))
        else:
            a, b, links, groups = x
            text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
            out.append((a, b, len(groups), len(links), sum(held[k] == most[k[0]] for k in links), sum(held[k] for k in links), hashlib.sha256(text.encode()).hexdigest(), sum(len(p) * len(q) for p, q in groups)))
    return out


@pytest.mark.parametrize("head", [40, cross_tokens.HEAD])
def test_alignment_equals_brute_force(spark, sf_dir, head):
    texts = nasty(250, 2) + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(60).collect()]
    texts += texts[-5:]
    rows = [(t, "x", i if i % 9 else None, "en") for i, t in enumerate(texts)]
    found = cross_tokens.cross_alignment(frame(spark, rows), head=head)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared"]
    expected = [(doc_id, *x) for (_, _, doc_id, _), x in zip(rows, brute_alignment(texts), strict=True)]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)


def test_alignment_of_nothing(spark):
    assert cross_tokens.cross_alignment(frame(spark, [])).collect() == []
    assert cross_tokens.cross_alignment(frame(spark, [(None, "x", 1, "en")])).collect()[0]["n_groups"] == 0


def test_group_links_are_those_of_the_groups():
    own = cross_tokens.aligner(*cross_tokens.paths())
    text = " a strange 漢字 wording, antidisestablishmentarianism"
    a, b = own.left.encode(text), own.right.encode(text)
    pairs = [(int(i), int(j)) for rows, cols in cross_tokens.group_links(a, b, own, block=3) for i, j in zip(rows, cols, strict=True)]
    group_a, group_b = cross_tokens.groups(own.left.lengths[a], own.right.lengths[b])
    assert pairs == [(i, j) for i in range(len(a)) for j in range(len(b)) if group_a[i] == group_b[j]]


# 13 collocations --------------------------------------------------------------------------------


def brute_phrases(rows, least, longest, top):
    counts, total = collections.defaultdict(collections.Counter), collections.Counter()
    for text, _, _, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, found in counts.items():
        own = []
        often = {p: n for p, n in found.items() if len(p) > 1 and n >= least}
        for p, a in often.items():
            if any(len(q) > len(p) and often[q] >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q in often):
                continue
            score, k = min((1000 * a * total[lang] // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p)))
            own.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(own)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def phrases(n, seed=5):
    r = random.Random(seed)
    words = ["the", "of", "Old", "red", "é", " ", "漢字", *(f"w{i}" for i in range(25))]
    lines = [" ".join(r.choices(words, k=6)) for _ in range(8)]
    out = [("", "x", 0, "en"), (None, "x", None, None), (" .,;\n\t", "x", 2, "fr")]
    for i in range(n):
        text = "".join(r.choice([*lines, r.choice(words)]) + r.choice([" ", "  ", "\t", ". ", ",", "\n", "\r\n", " ", " "]) for _ in range(r.randint(1, 12)))
        out.append((text, "x", i, r.choice(["en", "en", "en", "fr", None])))
    return out


@pytest.mark.parametrize(("least", "top", "frontier"), [(3, 2000, 1 << 16), (2, 12, 14)])
def test_collocations_equal_brute_force(spark, least, top, frontier):
    rows = phrases(90)
    found = collocations.collocations(frame(spark, rows).repartition(3), least=least, top=top, frontier=frontier)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == brute_phrases(rows, least, 5, top)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(frame(spark, [])).collect() == []
    assert collocations.collocations(frame(spark, [("a b", "x", 1, "en")])).collect() == []

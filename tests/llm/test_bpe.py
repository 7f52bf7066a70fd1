"""Tokens against the tokenizers library, and the pair check against exact merging."""

import json
import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from clientscope.llm import bpe  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def agree(library, texts, codec=None):
    made = (codec or bpe.codec(PATH)).encode(texts)
    for t, (ids, decoded), want in zip(texts, made, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, t
        assert decoded == library.decode(want.ids, skip_special_tokens=False)


def test_hard_texts(library):
    rng = random.Random(2)
    ranges = ((32, 0x250), (0x370, 0x700), (0x3000, 0xD7FF), (0x1F300, 0x1FAFF), (0x1000, 0x2FFF), (0x10000, 0x10FFFF))
    agree(library, ["".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(rng.randrange(1, 60))) for _ in range(3000)])
    agree(library, ["ΑΣ ΟΔΟΣ σΣ", "İstanbul Iı", "<|endoftext|>x <|STARTOFTEXT|> <|startoftext|>", "a<|endoftext|><|endoftext|>"])
    agree(library, ["é é Å", "don't DON'T I'LL x'Ll", "\x00\x01 \x85  ​", "", " ", "ﬁ ß ẞ", "12345 x9"])
    agree(library, [c * n for c in ("a", "ha", "!", ".-_", "é", "日本") for n in (1, 2, 3, 7, 50, 3000)])


def test_joined_tokens(library):
    """Words put together from the vocabulary's own tokens, where the longest match is often wrong."""
    codec, rng = bpe.codec(PATH), random.Random(3)
    byte_of = {letter: b for b, letter in enumerate(codec.letters)}
    parts = [bytes(byte_of[x] for x in t.removesuffix("</w>")).decode(errors="ignore") for t in codec.merges.text if t]
    words = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))) for _ in range(20_000)]
    agree(library, words)
    lettered = ["".join(codec.letters[b] for b in w.encode()) for w in words if w.isalpha() and w.islower()]
    proposed = [codec.merges.greedy(w) for w in lettered]
    exact = [codec.merges.exact(w) for w in lettered]
    assert codec.merges.encode(lettered) == exact and 0 < sum(a == b for a, b in zip(proposed, exact, strict=True)) < len(exact)


def test_pair_check_is_exact():
    """Two tokens stand next to each other exactly if merging their letters gives them again."""
    merges, rng = bpe.codec(PATH).merges, random.Random(4)
    inside, final = list(merges.inside.items()), list(merges.final.items())
    pairs = [(rng.choice(inside), rng.choice(final)) for _ in range(20_000)]
    clash = merges.clash(np.array([a[1] for a, _ in pairs]), np.array([b[1] for _, b in pairs]))
    assert [not c for c in clash] == [merges.exact(a[0] + b[0]) == [a[1], b[1]] for a, b in pairs] and clash.any() and not clash.all()


def test_usual_letters_are_the_librarys():
    codec = bpe.codec(PATH)
    usual = [chr(x) for x in range(0x110000) if not 0xD800 <= x < 0xE000 and not bpe.UNUSUAL.match(chr(x))]
    text = " ".join(f"a{c}!" for c in usual)
    assert len(usual) > 30_000 and [w for w, _ in codec.split.pre_tokenize_str(text)] == codec.pattern.findall(text)
    composed = [c for c in usual if not c.isspace()]
    assert codec.folds and all(codec.normal(f"a{c}b") == codec.normalizer.normalize_str(f"a{c}b") for c in composed)
    assert codec.merges.merged([*range(300, 340)] * 2) == codec.merges.merged_far([*range(300, 340)] * 2)


def small_file(path, merges, letters="abc"):
    vocab = {x: i for i, x in enumerate([*letters, *[f"{x}</w>" for x in letters]])}
    for a, b in merges:
        vocab.setdefault(a + b, len(vocab))
    split = {"type": "Split", "pattern": {"Regex": "[\\p{L}]+"}, "behavior": "Removed", "invert": True}
    steps = [split, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
    model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>",
             "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": vocab, "merges": merges}
    made = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "decoder": None, "post_processor": None,
            "pre_tokenizer": {"type": "Sequence", "pretokenizers": steps}, "model": model}
    path.write_text(json.dumps(made))
    return str(path)


def test_small_vocabularies(tmp_path):
    """Random merges, among them tokens that their own letters never reach, and merges out of order."""
    rng, seen = random.Random(5), set()
    for k in range(60):
        parts, merges = ["a", "b", "c", "a</w>", "b</w>", "c</w>"], []
        while len(merges) < rng.randrange(2, 16):
            a, b = rng.choice([p for p in parts if not p.endswith("</w>")]), rng.choice(parts)
            if (a, b) not in merges:
                merges.append((a, b))
                parts += [a + b] if a + b not in parts else []
        if k % 3 == 2:
            rng.shuffle(merges)
        path = small_file(tmp_path / f"{k}.json", merges)
        codec = bpe.Codec(path)
        seen.add(codec.merges.ordered)
        agree(tokenizers.Tokenizer.from_file(path), ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 14))) for _ in range(300)], codec)
    assert seen == {True, False}


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        bpe.Codec(public_tokenizers.path("byte_bpe_50k.json"))


def test_frames(spark, library):
    long = " ".join(f"word{i % 97} stays{i}" for i in range(20_000))
    rows = [(1, "Hello world"), (1, "Hello world"), (2, ""), (3, None), (None, "Nothing <|endoftext|>"), (None, None), (4, long), (5, "x" * 100_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("ids", "n_tokens", "decoded", "known")})
    made = bpe.token_texts(frame, PATH).collect()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    assert sorted(((r[0], r[1], bytes(r[2]), r[3]) for r in made), key=repr) == sorted(want, key=repr)
    assert bpe.token_texts(frame.limit(0), PATH).collect() == [] and len(regex.findall("stays", made[0].decoded)) >= 0

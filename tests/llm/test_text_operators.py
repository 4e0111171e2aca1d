"""Operators that look at one text at a time, against brute force and over odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from fathomline.llm import chat, language_id, packing, pii, quality, token_files, toxicity
from fathomline.llm.bpe import Encoder

BPE = public_tokenizers.path("byte_bpe_50k.json")
LONG = "word " * 60_000
ODD = [(1, "plain text of ten words or so, nothing odd in it at all."), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (6, "same\nsame\nsame"), (6, "same\nsame\nsame"), (None, "no id é ñ 中文 😀"), (7, "x" * 30_000)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", 1, "clash", 2.0) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _text string, score double")


def clean(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_encoder_equals_library(reference):
    e = Encoder(BPE)
    parts = ["a", "B", "é", "ñ", " ", "  ", "\n", "\t", "\r", "1", "23", "!", "...", "'s", "'ll", "\xa0", " ", "\x1c", "́", "😀", "中", "<|endoftext|>", "_", "²", "​", "\x85", "'", "I'm", "word,", "x.\nY"]
    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert e.encode(text).tolist() == reference(text), repr(text)


def test_rans_round_trip():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(1, np.int64), np.full(5000, 7), rng.integers(0, 50257, 70_000), np.minimum(rng.zipf(1.3, 300_000), 50_000), np.arange(60_000)):
        row = token_files.encode_segment([ids])
        assert np.array_equal(token_files.decode_segment(row["symbols"], row["frequencies"], row["blocks"], row["checks"]), ids)
        bad = [b[:-1] + bytes([b[-1] ^ 1]) for b in row["blocks"]]
        if len(ids) > 5000:
            with pytest.raises((ValueError, IndexError)):
                token_files.decode_segment(row["symbols"], row["frequencies"], bad, row["checks"])


def test_token_files(spark, odd, tmp_path, reference):
    path = f"file://{tmp_path}/t"
    token_files.write_token_files(odd, path, BPE)
    got = token_files.read_token_files(spark, path, digest=True).collect()
    start = 0
    want = []
    for doc, text in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*reference(text or ""), 0], "<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert clean(got) == clean(want)
    ids = {r["doc_id"]: r["ids"] for r in token_files.read_token_files(spark, path).collect()}
    assert ids[3] == [0] and ids[1] == [*reference(ODD[0][1]), 0]
    empty = f"file://{tmp_path}/e"
    token_files.write_token_files(odd.limit(0), empty, BPE)
    assert token_files.read_token_files(spark, empty).count() == 0


def test_cuts():
    for n in range(1, 5000):
        parts = packing.cuts(n)
        assert sum(parts) == n and max(parts) <= 1024 and min(parts) > 0
        assert parts == sorted(parts, reverse=True)


def test_packing(spark, odd, reference):
    pieces = packing.packed(odd, BPE, with_ids=True).collect()
    whole = sorted([*reference(t or ""), 0] for _, t in ODD if _ not in (6,))
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    got = []
    for (doc, n), ps in by_doc.items():
        ids = [i for p in sorted(ps, key=lambda p: p["start"]) for i in p["ids"]]
        if doc == 6:
            assert len(ids) == 2 * n
        else:
            assert len(ids) == n
            got.append(ids)
    assert sorted(got) == whole
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] == len(p["ids"]) and p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes())
            at += p["length"]
        assert at <= 1024
    assert packing.packed(odd.limit(0), BPE).count() == 0


def test_harmonic_bins_hold_a_fixed_count():
    closed = []
    bins = packing.Packer(lambda s, ps: closed.append(ps))
    for n in (512, 300, 341, 512, 341, 300, 341, 1024):
        bins.add((1, 0, np.zeros(n, np.uint16), n))
    assert [len(c) for c in closed] == [2, 3, 1]
    bins.end()
    assert sum(len(i) for c in closed for _, _, i, _ in c) == 512 * 2 + 300 * 2 + 341 * 3 + 1024


def base_spans(text):
    out = []

    def luhn(s):
        return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(s))) % 10 == 0

    shapes = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    for kind, shape in shapes:
        for m in re.finditer(shape, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": all(int(x) < 256 for x in m.group().split(".")) if kind == "ip" else 0, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_base_equals_brute_force(spark):
    rng = random.Random(2)
    parts = ["a", "b@c.de", "@", ".", "x_", "%", "-", " ", "1", "23", "4111 1111 1111 1111", "4111111111111111", "255.1.2.3", "256.", "007.1.1.1", "+1 (22", ")", "+49 30 1234567", "é", "\n", "+", "0", "4929-7203-1234-5670", "00000000000000000000"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    texts += ["x@y" + ".a" * 20_000, "1" * 40_000, "a" * 50_000 + "@", "+1" + "-" * 30_000, "1.2.3.4 " * 3000, "a@b.c_x@d.ef, a@b@c.de"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = pii.with_spans(df).select("doc_id", "spans").collect()
    for r in rows:
        assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"] if s["base"]] == base_spans(texts[r["doc_id"]]), texts[r["doc_id"]][:200]


def test_pii_adds_by_checksum_and_context(spark, odd):
    text = "Konto DE89 3704 0044 0532 0130 00, not DE88 3704 0044 0532 0130 00; ssn 123-45-6789 here."
    pad = " " + "x" * 60 + " "
    df = spark.createDataFrame([(1, text), (2, f"{pad}123-45-6789{pad}")], "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], s["score"]) for s in r["spans"]] for r in pii.with_spans(df).collect()}
    assert got == {1: [("iban", 1.0), ("ssn", 0.8)], 2: []}
    out = pii.with_spans(odd)
    assert out.columns == [*odd.columns, "spans"] and out.count() == len(ODD) and pii.with_spans(odd.limit(0)).count() == 0


def test_iban_ends_where_the_account_ends(spark):
    de, gb, fr = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "FR1420041010050500013M02606"
    bare = de.replace(" ", "")
    good = [(f"IBAN {bare} Thank you", [bare]), (f"{de} BIC COBADEFF", [de]), (f"{de} 17 EUR", [de]), (f"{bare} {gb} {fr} A", [bare, gb, fr]), (f"{gb}, {de}", [gb, de]), (f"É {fr} ÉA", [fr])]
    bad = [(f"{bare}X", []), (f"{bare}x", []), (f"X{bare}", []), (de.replace("89", "88", 1) + " BIC", []), ("DE89 3704", []), ("AB12 " * 9, []), ("", [])]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(good + bad)], "doc_id long, text string")
    for r in pii.with_spans(df).collect():
        text, want = (good + bad)[r["doc_id"]]
        assert [text[s["start"] : s["end"]] for s in r["spans"] if s["kind"] == "iban"] == want, text

    def passes(s):
        return {"DE": 22, "GB": 22, "FR": 27}.get(s[:2], len(s)) == len(s) and 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1

    rng = random.Random(12)
    parts = [de, gb, fr, bare, "GB82WEST12345698765432", "AB12", "A", "7", "x", "BIC COBADEFF", "\n", ",", "é", "DE89", "0" * 30]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 12))) for _ in range(1500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in pii.with_spans(df).collect():
        text, want, at = texts[r["doc_id"]], [], 0
        for m in re.finditer(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}", text):
            body = re.match(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9])*", text[m.start() :]).group()
            ends = [m.start() + n for n in range(15, len(body) + 1) if body[n - 1] != " " and not re.match("[A-Za-z0-9]", text[m.start() + n :]) and passes(body[:n].replace(" ", ""))]
            if ends and m.start() >= at:
                at = max(ends)
                want.append((m.start(), at))
        assert [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "iban"] == want, text


def test_quality_measures_equal_brute_force(spark, odd):
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice(["a ", "b ", "c\n", "a b ", "#", "\t", "\n", "é", "|"]) for _ in range(rng.randint(0, 60)))
        t, words = quality.Text(text), re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        hit = {j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(k, k + 5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (t.n_words, t.word_chars, t.n_repeat_words, t.n_symbols) == (len(words), sum(map(len, words)), len(hit), len(re.findall(r"[#*$%&|<>]", text)))
        assert t.n_dup_lines == sum(x in lines[:k] for k, x in enumerate(lines))
    assert quality.Text(LONG).n_repeat_words == 60_000
    rules = quality.order(odd)
    assert set(rules) == set(quality.RULES)
    a = clean(quality.judged(odd, rules, quality.MEASURES, reasons=True).collect())
    assert a == clean(quality.judged(odd, quality.RULES[::-1], quality.MEASURES, reasons=True).collect()) and len(a) == len(ODD)
    assert quality.filtered(odd, rules).columns == odd.columns
    assert quality.judged(odd.limit(0)).count() == 0 and quality.filtered(odd.limit(0)).count() == 0


def test_language(spark, odd, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = language_id.held_out(docs["doc_id"])
    model = language_id.fit(docs.where(~out))
    got = language_id.identified(docs, model).join(docs.select("doc_id", "lang", out.alias("out")), "doc_id").where("out").selectExpr("avg(int(lang = lang_pred)) a").first()["a"]
    assert got >= 0.95
    rows = {r["doc_id"]: r for r in language_id.identified(odd, model).collect()}
    assert all(rows[k]["lang_pred"] == "und" and rows[k]["score"] == 0 for k in (2, 3, 4)) and 0 < rows[1]["score"] <= 1
    assert language_id.fit(odd.limit(0)) is None
    assert {r["lang_pred"] for r in language_id.identified(odd, None).collect()} == {"und"}


def test_kernel_is_the_presence_kernel():
    find = language_id.Presence()
    from fathomline.llm.ngrams import classes

    def brute(text):
        c = classes(" " + text + " ").tolist()
        return {tuple(c[k : k + n]) for n in (1, 2, 3) for k in range(len(c) - n + 1)}

    a, b = "then the other", "other hands"
    x, y = set(find(classes(a)).tolist()), set(find(classes(b)).tolist())
    assert (len(x), len(y), len(x & y)) == (len(brute(a)), len(brute(b)), len(brute(a) & brute(b)))


def test_toxicity(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    texts = docs.limit(1).collect()[0]["text"][:300]
    rows = spark.createDataFrame([(i, f"{texts} {i} " + (f"you are a {('loser', 'scum')[i // 4 % 2]}" if i % 4 == 0 else "you are a fine")) for i in range(400)], "doc_id long, text string")
    lm = toxicity.language(docs.select("text").unionByName(rows.select("text")))
    model = toxicity.fit(rows, labels, lm)
    tests = [(1, f"{texts} loser"), (2, f"{texts} l0ser and scum"), (3, texts), (4, None), (5, ""), (6, f"{texts} l o s e r")]
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(spark.createDataFrame(tests, "doc_id long, text string"), lm, model).collect()}
    assert min(got[1], got[2], got[6]) > 0.3 > max(got[3], got[4], got[5])
    assert toxicity.fit(rows, labels.limit(0), lm).score(np.zeros(0, np.uint8)) == 0.5
    assert toxicity.scored(rows.limit(0), lm, model).count() == 0
    kept = toxicity.filtered(spark.createDataFrame(tests, "doc_id long, text string"), lm, model)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5]


def test_viterbi_restores(spark, small):
    lm = toxicity.language(spark.createDataFrame([("the trash and the idiot are pathetic scum " * 50,)], "text string"))
    r = toxicity.Restorer(lm)
    assert r.restore("such t r a s h")[0] == "such trash"
    assert r.restore("p@th3tic, 1d1ot!!")[0] == "pathetic, idiot!!"
    assert r.restore("iiidiottt")[0] == "idiot"
    assert r.restore("plain words stay, 42 too")[0] == "plain words stay, 42 too"


def test_viterbi_restores_stretches_of_any_length(spark):
    words = "you are a worthless stupid idiot"
    lm = toxicity.language(spark.createDataFrame([(f"{words} " * 50,)], "text string"))
    r = toxicity.Restorer(lm)
    for n in (1, 2, 40):
        text = " ".join([words] * n).replace(" ", "")
        assert r.restore(" ".join(text))[0].replace(" ", "").count("stupid") == n
    assert r.restore("st" + "u" * 60 + "pid")[0] == "stupid"
    assert r.restore("st*pid " + "stup1d1d10t" * 30)[0] == "stupid " + "stupididiot" * 30

    def whole(stretch):
        """The best path by strings that grow along all paths."""
        states = {0: (0.0, "")}
        for options in [*toxicity.lattice(stretch), [(" ", 0.0)]]:
            new = {}
            for state, (score, text) in states.items():
                for string, cost in options:
                    x, s = state, score + cost
                    for ch in string:
                        c = toxicity._class(ch)
                        s += lm.table[x << 6 | c]
                        x = (x << 6 | c) & 0xFFF
                    if x not in new or new[x][0] < s:
                        new[x] = (s, text + string)
            states = new
        return max(states.values())[1].strip()

    rng = random.Random(9)
    for _ in range(300):
        stretch = rng.choice(["", " "]).join(rng.choice("stupidao01!|*@") for _ in range(rng.randint(1, 60)))
        stretch = stretch.replace("***", "*")
        assert toxicity.decode(stretch, lm) == whole(stretch), stretch


def test_chat(spark):
    rng = random.Random(4)
    parts = ["\\", "###", "</turn>", "### user:\n", "\n", "a", "é", "<", ":", "#"]
    rows = []
    for conv in range(150):
        for turn in range(rng.randint(1, 4)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system"]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))))
    rows += [(200, 0, None, None), (None, 0, "gpt", "x"), (201, 0, "assistant", LONG), (202, 1, "user", "b"), (202, 1, "user", "b")]
    df = spark.createDataFrame([(*r, "y") for r in rows], "conv_id long, turn long, role string, text string, messages string")
    got = {r["conv_id"]: r for r in chat.digests(chat.segments(chat.turns(df))).collect()}
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, {"gpt": "assistant", None: ""}.get(role, role), text or ""))
    for conv, turns in by.items():
        turns.sort(key=lambda t: t[0])
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        row = got.pop(conv)
        assert (row["n_turns"], row["turns_sha256"], row["loss_chars"], row["loss_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert not got
    assert chat.digests(chat.segments(chat.turns(df.limit(0)))).count() == 0
    whole = "".join(r["formatted"] for r in chat.segments(chat.turns(df)).where("conv_id = 3").orderBy("turn").collect())
    assert [t for _, t in chat.parsed(whole)] == [t for c, _, _, t in rows if c == 3]
    with pytest.raises(ValueError):
        chat.parsed(whole + "x")


def test_layouts(spark):
    import json

    records = [{"messages": [{"role": "human", "content": "q"}, {"role": "assistant", "content": "a", "name": 1}]}, {"conversations": [{"from": "gpt", "value": "v"}]}, {"instruction": "i", "input": "", "output": "o"}, {"prompt": "p", "response": "r", "id": 4}, {"x": 1}, [1]]
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(records)] + [(9, None), (10, "{")], "conv_id long, raw string")
    got = [tuple(r) for r in chat.json_turns(df, "raw").orderBy("conv_id", "turn").collect()]
    assert got == [(0, 0, "user", "q"), (0, 1, "assistant", "a"), (1, 0, "assistant", "v"), (2, 0, "system", "i"), (2, 1, "user", ""), (2, 2, "assistant", "o"), (3, 0, "user", "p"), (3, 1, "assistant", "r")]
    nested = spark.createDataFrame([(1, [("user", "q"), ("bot", "a")])], "conv_id long, messages array<struct<role: string, content: string>>")
    assert [tuple(r) for r in chat.turns(nested).collect()] == [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    flat = spark.createDataFrame([(1, "q", "a")], "conv_id long, question string, answer string")
    assert [tuple(r) for r in chat.turns(flat).collect()] == [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    with pytest.raises(ValueError):
        chat.turns(spark.createDataFrame([(1, 2)], "conv_id long, other long"))

"""Operators against plain Python on small corpora."""

import os
import hashlib
import math
import random
import re
import struct
from collections import Counter, defaultdict

import pytest
import zlib
from pyspark.sql import functions as F

from kinweave.llm import bpe, brown, components, decontaminate, embeddings, langid, licenses, linededup, pages, secrets, shingles, transducer
from kinweave.llm.queries import word_bpe_path


def roots(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + r.randrange(40)) for _ in range(80)] + [(200, 200), (300, 301), (301, 300)]
    got = {x.id: x.component for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    ends = {x for a, b in links if a != b for x in (a, b)}
    assert got == {i: c for i, c in roots(ends, [x for x in links if x[0] != x[1]]).items()}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_ids_with_many_links(spark, monkeypatch):
    r = random.Random(3)
    monkeypatch.setattr(components, "HOT", 8)
    for centre in (0, 500, 10_000):
        links = [(centre, x) for x in r.sample(range(1, 9_999), 300)] + [(r.randrange(20_000, 20_400), r.randrange(20_000, 20_400)) for _ in range(250)]
        got = {x.id: x.component for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
        assert got == roots({x for a, b in links if a != b for x in (a, b)}, links)


def words(r, n, vocabulary="the of and to in a is that it was for on are as with his they at be this have from or one had by word but not what all were we when your can said there use an each which she do how their if will up other about out many then them these so some her would make like him into time has look two more write go see number no way could people".split()):
    return [r.choice(vocabulary) + r.choice(["", "", "s", "ed", "ing"]) for _ in range(n)]


def test_jaccard_join(spark):
    r = random.Random(4)
    texts = []
    for _ in range(25):
        base = words(r, r.choice([3, 20, 60, 200]))
        for _ in range(r.randrange(1, 9)):
            copy = list(base)
            for _ in range(r.randrange(0, 1 + len(base) // 40)):
                copy[r.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    texts += ["", " ", "one two"] * 2
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    wanted, degree = roots(range(len(texts)), links), Counter(x for link in links for x in link)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for tile in (512, 3):
        got = {x.doc_id: (x.class_id, x.n_links) for x in shingles.near_duplicates(df, tile=tile).collect()}
        assert got == {i: (wanted[i], degree[i]) for i in range(len(texts))}
    assert sorted(x.doc_id for x in shingles.keep_one(df).collect()) == sorted(set(wanted.values()))


def test_prefixes_shorten_until_the_recall_is_met():
    import numpy as np

    floor = shingles.shortest(0.8)
    assert shingles.meeting(0.8, floor, shingles.TREES) >= shingles.RECALL > shingles.meeting(0.8, floor + 1, shingles.TREES)
    at = 0.8 + 0.2 * np.arange(shingles.GRADES) / shingles.GRADES
    for links in ([0] * 20, [5] + [0] * 19, [0] * 19 + [10**6], [1000] * 20, [0] * 10 + [10**5] * 10):
        links = np.array(links, float)
        depth = shingles.shortened(links, 8, 0.8, shingles.TREES, floor, shingles.RECALL)
        real = (links + (at == 0.8)) / shingles.meeting(at, 8, shingles.TREES)
        share = lambda d: (real * shingles.meeting(at, d, shingles.TREES)).sum() / real.sum()  # noqa: E731, B023
        assert floor <= depth <= 8 and share(depth) >= shingles.RECALL and (depth == 8 or share(depth + 1) < shingles.RECALL)
    # Many links of nearly equal sets need no short prefixes; links at the wanted similarity do.
    assert shingles.shortened(np.array([0] * 19 + [10**6]), 8, 0.8, 20, floor, 0.999) == 8
    assert shingles.shortened(np.array([100.0] + [0] * 19), 8, 0.8, 20, floor, 0.999) == floor


@pytest.mark.parametrize("floor", [1, 2, 3])
def test_forest_connects_what_shares_a_prefix(spark, floor):
    r = random.Random(11)
    rows = [(i * 7919 % 1000 - 500, bytes(r.choice(b"ab") for _ in range(3 * 4))) for i in range(300)]
    df = spark.createDataFrame(rows, "s long, labels binary").repartition(3)
    links = [(x.a, x.b, x.depth) for x in shingles.forest(df, trees=3, deepest=4, floor=floor).collect()]
    ids = [s for s, _ in rows]
    for depth in range(floor, 5):
        same = defaultdict(list)
        for s, label in rows:
            for t in range(3):
                same[t, label[4 * t : 4 * t + depth]].append(s)
        wanted = roots(ids, [(x[0], y) for x in same.values() for y in x])
        assert roots(ids, [(a, b) for a, b, d in links if d >= depth]) == wanted
        # No link joins what doesn't agree.
        held = dict(rows)
        assert all(any(held[a][4 * t : 4 * t + d] == held[b][4 * t : 4 * t + d] for t in range(3)) for a, b, d in links)
    assert len(links) <= 300 * 3 * 4


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def edited(r, text, n, letters="abc xyz"):
    out = list(text)
    for _ in range(n):
        if not out:
            break
        at, kind = r.randrange(len(out)), r.randrange(3)
        if kind == 0:
            out[at] = r.choice(letters)
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, r.choice(letters))
    return "".join(out)


def test_edit_distances():
    r = random.Random(2)
    for edits in (1, 2, 3):
        for _ in range(1500):
            a = "".join(r.choice("ab") for _ in range(r.randrange(1, 12)))
            b = edited(r, a, r.randrange(4), "ab")
            assert linededup.within(a, b, edits) == (distance(a, b) <= edits)


def test_near_lines_are_those_within_edits():
    r = random.Random(22)
    for letters in ("ab ", "a 字b", "字 あx"):
        for _ in range(1500):
            a = linededup.normal("".join(r.choice(letters) for _ in range(r.randrange(2, 30))))
            b = linededup.normal(edited(r, a, r.randrange(5), letters))
            assert linededup.near(a, b, 2, 10**6) == (distance(a, b) <= 2), (a, b)
            words = [linededup._WORDS.findall(x) for x in (a, b)]
            wanted = distance(a, b) <= 2 or distance(*words) <= linededup.word_edits(min(map(len, words)))
            assert linededup.near(a, b, 2, 0) == wanted, (a, b)


def test_segments_meet_wherever_lines_are_near():
    r = random.Random(23)
    for _ in range(3000):
        a = "".join(r.choice("ab") for _ in range(r.randrange(6, 40)))
        b = edited(r, a, r.randrange(3), "abc")
        if len(b) >= 4 and distance(a, b) <= 2:
            index, index_of, probe, probe_of = linededup.keys_of([a, b], 2, 4)
            probe, probe_of = [*probe, *index], [*probe_of, *index_of]
            assert any(x == y and i != j for x, i in zip(index, index_of) for y, j in zip(probe, probe_of)), (a, b)


def test_line_dedup(spark):
    r = random.Random(8)
    lines = [" ".join(words(r, r.randrange(6, 14))) for _ in range(40)]
    docs = []
    for i in range(30):
        own = [r.choice(lines) for _ in range(r.randrange(1, 6))]
        docs.append((i, "\n".join(edited(r, x, r.randrange(4)) if r.random() < 0.4 else x for x in own)))
    places = defaultdict(list)
    for i, text in docs:
        for n, line in enumerate(text.split("\n")):
            if len(line := linededup.normal(line)) >= 30:
                places[line].append((i, n))
    known = list(places)
    links = [(a, b) for a in range(len(known)) for b in range(a) if distance(known[a], known[b]) <= 2]
    groups = defaultdict(list)
    for i, top in roots(range(len(known)), links).items():
        groups[top] += places[known[i]]
    dropped = defaultdict(set)
    for own in groups.values():
        for i, n in sorted(own)[1:]:
            dropped[i].add(n)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for tile in (512, 3):
        got = {x.doc_id: set(x.dropped) for x in linededup.repeated(df, tile=tile).collect()}
        assert got == {i: dropped[i] for i, _ in docs} and any(got.values())
    left = {x.doc_id: x.text for x in linededup.dedup(df).collect()}
    wanted = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in dropped[i]) for i, t in docs}
    assert left == {i: t for i, t in wanted.items() if t.strip() or not dropped[i]}


def reworded(r, line, n):
    out = line.split(" ")
    for at in r.sample(range(len(out)), n):
        out[at] = "".join(r.choice("aeioukl") for _ in range(r.randrange(4, 9)))
    return " ".join(out)


def test_long_lines_with_other_words(spark):
    r = random.Random(12)
    docs, wanted = [], {}
    for k, (size, n) in enumerate([(300, 1), (300, 2), (300, 2), (120, 1), (700, 5), (3000, 20), (300, 12)]):
        line = ""
        while len(line) < size:
            line = (line + " " + "".join(words(r, 1)) + r.choice("aeiou")).strip()
        docs += [(2 * k, line), (2 * k + 1, reworded(r, line, n))]
        wanted[2 * k], wanted[2 * k + 1] = 0, int(n < 12 or size > 300)
    letters = [chr(r.randrange(0x4E00, 0x9000)) for _ in range(150)]
    docs += [(90, "".join(letters)), (91, "".join(letters[:40] + ["\u3042"] * 4 + letters[42:]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {x.doc_id: x.n_dropped for x in linededup.repeated(df).collect()} == wanted | {90: 0, 91: 1}


def test_word_join_finds_all_near_lines():
    r = random.Random(13)
    for _ in range(400):
        a = [r.choice("abcdefgh") * r.randrange(1, 9) + str(r.randrange(30)) for _ in range(r.randrange(25, 260))]
        b = edited(r, [x + " " for x in a], r.randrange(8), ["new ", "other ", "x "])
        b = b.split()
        lines = [" ".join(a), " ".join(b)]
        if distance(a, b) <= linededup.word_edits(min(len(a), len(b))) and min(map(len, lines)) >= 100:
            index, index_of, probe, probe_of = linededup.word_keys(lines, 100)
            probe, probe_of = [*probe, *index], [*probe_of, *index_of]  # index entries are probes as well
            met = {(i, j) for x, i in zip(index.tolist(), index_of.tolist()) for y, j in zip(map(int, probe), map(int, probe_of)) if x == y and i != j}
            assert met and linededup.near(*lines, 2, 100)
        assert linededup.apart(a[:40], b[:40]) == distance(a[:40], b[:40])


def least_distance(item, text):
    """The least distance of the item from any part of the text, by the plain table."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for d in text:
        new = [0]
        for j, c in enumerate(item, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row, best = new, min(best, new[-1])
    return best


def test_decontamination(spark):
    r = random.Random(6)
    items = [" ".join(words(r, 30)) for _ in range(6)] + ["same item text here for two", "same item text here for two", "q", "zx", "Short One", "a few words", "", "  "]
    docs = []
    for i in range(40):
        k = r.randrange(len(items) - 2)
        docs.append((i, " ".join(words(r, 40)) + " " + edited(r, items[k], r.randrange(0, len(items[k]) // 7 + 1)) + "\n  " + " ".join(words(r, 40)).upper()))
    plain = [x.lower().strip() for x in items]
    wanted = {(i, k): d for i, t in docs for k, x in enumerate(plain) if x and (d := least_distance(x, " ".join(t.lower().split()))) <= len(x) // 10}
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for block in (4_000_000, 500):
        got = {(x.doc_id, x.item_id): x.distance for x in decontaminate.matches(df, bench, block_chars=block).collect()}
        assert got == wanted and len(wanted) > 20 and {7, 8, 9, 10, 11} & {k for _, k in wanted}
    assert {x.item_id for x in decontaminate.matches(df, bench, min_chars=16).collect()} == {k for _, k in wanted if len(items[k]) >= 16}
    assert {x.doc_id for x in decontaminate.clean(df, bench, block_chars=500).collect()} == {i for i, _ in docs} - {i for i, _ in wanted}


def test_myers():
    r = random.Random(3)
    for _ in range(1500):
        a, b = ("".join(r.choice("ab c") for _ in range(r.randrange(1, n))) for n in (r.choice([5, 70]), r.choice([6, 90])))
        assert decontaminate.Item(a, 0.1).distance(b) == least_distance(a, b)


def test_pieces_find_every_place():
    r = random.Random(14)
    for _ in range(800):
        item = "".join(r.choice("ab c") for _ in range(r.randrange(1, 60))).strip() or "a"
        text = "".join(r.choice("abc ") for _ in range(r.randrange(40))) + edited(r, item, r.randrange(len(item) // 8 + 1), "abc ") + "".join(r.choice("abc ") for _ in range(r.randrange(40)))
        d = least_distance(item, text)
        assert decontaminate.Matcher([item], 0.1).find(text) == ({0: d} if d <= len(item) // 10 else {}), (item, text)


def test_secrets(spark):
    texts = ['TOKEN = "abcdef123" pass', "password=token: abcdefgh secret:short1", "AKIA" + "A" * 16 + " " + "0a" * 12 + "é " + "f" * 23, "ſecret=abcdefgh toKen=xyzxyz1", "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a" * 36]
    patterns = {"assign": r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}

    def base(t):
        out = [(m.start(), 0, m.end()) for m in re.finditer(patterns["assign"], t, re.A | re.I) if len(m[2]) >= 6]
        out += [(m.start(), 1, m.end()) for m in re.finditer(patterns["access"], t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer(patterns["hex"], t) if len(m[0]) >= 24]
        return ",".join(f"{list(patterns)[k]}:{a}:{b}" for a, k, b in sorted(out))

    rows = [(i, t, f"o{i}") for i, t in enumerate(texts)] + [(10 + i, "token=copied_example", f"p{i}") for i in range(4)] + [(20 + i, "token=live_looking_1", "q") for i in range(4)]
    got = {x.doc_id: x for x in secrets.secret_scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    for i, t in enumerate(texts):
        assert got[i].base_sha256 == hashlib.sha256(base(t).encode()).hexdigest()
        assert set(base(t).split(",")) - {""} <= set(got[i].spans.split(","))
    assert "github:" in got[4].spans and "pem:0:" in got[4].spans
    assert (got[10].n_live, got[10].n_examples) == (0, 1) and (got[20].n_live, got[20].n_examples) == (1, 0)


def test_secrets_by_repositories_and_keys(spark):
    key = "-----BEGIN RSA PRIVATE KEY-----\n" + "MIIabc+/" * 8 + "\n" + "Zz09" * 5 + "\n-----END RSA PRIVATE KEY-----"
    rows = [(i, "token=copied_by_one", "hot") for i in range(12)] + [(20, key, "a"), (21, "x " + key.replace("\n", "\\n"), "b"), (22, "-----BEGIN PRIVATE KEY----- and no more", "c"), (23, key[:70] + "! -----BEGIN PRIVATE KEY-----", "c")]
    got = {x.doc_id: x for x in secrets.secret_scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all((got[i].n_live, got[i].n_examples, got[i].n_repos, got[i].n_owners) == (0, 1, [12], [1]) for i in range(12))
    assert got[20].n_live == got[21].n_live == got[23].n_live == 1 and got[20].hashes == got[21].hashes == got[20].live_hashes
    assert (got[20].n_repos, got[20].n_owners, got[22].n_live, got[22].n_repos) == ([2], [2], 0, [])


def test_transducer(tmp_path):
    r = random.Random(5)
    entries = {"".join(r.choice("abé") for _ in range(r.randrange(1, 8))).encode(): tuple(r.randrange(50) for _ in range(r.randrange(1, 4))) for _ in range(2000)}
    (tmp_path / "x").write_bytes(transducer.build(entries.items()))
    lexicon = transducer.Lexicon(tmp_path / "x")
    assert all(lexicon.get(w) == struct.pack(f"<{len(i)}I", *i) for w, i in entries.items())
    assert lexicon.get(b"") is None and lexicon.get(b"zz") is None
    shared = transducer.build([(w + b"ing", (1,)) for w in (b"a", b"b", b"c")])
    assert len(transducer.build([(b"aing", (1,))])) + 60 > len(shared)  # endings are shared


def test_bpe_is_the_library(spark):
    from tokenizers import Tokenizer

    path = word_bpe_path()
    tokenizer, r = Tokenizer.from_file(path), random.Random(9)
    texts = ["Don't STOP 'start it's 123 foo_bar!!", "x<|endoftext|> y<|startoftext|>", "ΑΣ Σ İI ﬁ \x1c a\x1db", "a" * 300 + " é ́", "\x85\xa0​﻿x", ""]
    texts += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0xA1, 0x530), r.randrange(0x1E00, 0x2000), r.randrange(0x4E00, 0x9000)])) for _ in range(r.randrange(80))) for _ in range(300)]
    coded = bpe.bpe(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, lexicon_words=50)
    decoded = {x.doc_id: x.decoded for x in bpe.decode(coded, path).collect()}
    for x in coded.collect():
        ids = tokenizer.encode(texts[x.doc_id], add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(ids)}I", x.ids)) == ids and x.n_tokens == len(ids)
        assert x.decoded == decoded[x.doc_id] == tokenizer.decode(ids, skip_special_tokens=False)


def test_language(spark):
    r = random.Random(7)
    own = {"en": words(r, 400), "de": "der die und das nicht ist ein mit auf für den von sich auch werden schön über groß".split() * 20, "fr": "le la les est dans pour avec être été une des que qui sur très".split() * 20}
    rows = [(i, " ".join(r.choice(own[lang]) for _ in range(30)), lang) for i, lang in enumerate(["en", "de", "fr"] * 40)]
    df = spark.createDataFrame(rows + [(999, "12 !", "en")], "doc_id long, text string, lang string")
    got = langid.predict(df, langid.train(langid.split_training(df)), keep={"doc_id": "doc_id", "lang": "lang"}).collect()
    held = [x for x in got if zlib.crc32(str(x.doc_id).encode()) % 3 == 1 and x.doc_id != 999]
    assert held and sum(x.lang == x.lang_pred for x in held) / len(held) > 0.95 and all(0 <= x.score <= 1 for x in got)
    assert [x.lang_pred for x in got if x.doc_id == 999] == ["und"]


def plain_language(rows, text):
    """Language and score by the rule alone: a word's log frequency, else the mean over its letters of the longest n-gram known from there."""
    units = defaultdict(Counter)
    for lang, t in rows:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            units["word"][lang, w] += 1
            for size in range(1, 6):
                for i in range(len(w) + 3 - size):
                    units[size][lang, f" {w} "[i : i + size]] += 1
    languages = sorted({lang for lang, _ in rows})
    known = {kind: {u for _, u in counts} for kind, counts in units.items()}
    total = {(kind, lang): sum(counts[lang, u] + 0.1 for u in known[kind]) for kind, counts in units.items() for lang in languages}
    log = lambda kind, lang, u: math.log10((units[kind][lang, u] + 0.1) / total[kind, lang])
    words, sums = re.findall(r"[^\W\d_]+", text.lower()), dict.fromkeys(languages, 0.0)
    for w in words:
        if w in known["word"]:
            found = [("word", w)]
        else:
            padded = f" {w} "
            found = [next(((n, padded[i : i + n]) for n in range(min(5, len(padded) - i), 0, -1) if padded[i : i + n] in known[n]), None) for i in range(len(padded))]
            found = [x for x in found if x]
        for lang in languages:
            sums[lang] += sum(log(kind, lang, u) for kind, u in found) / max(1, len(found))
    if not words:
        return "und", 0.0
    best = max(languages, key=lambda x: (sums[x], [-ord(c) for c in x]))
    scale = math.log(10) * min(10, len(words)) / len(words)
    return best, 1 / sum(math.exp((sums[x] - sums[best]) * scale) for x in languages)


def test_language_by_the_rule(spark):
    r = random.Random(17)
    letters = {"a": "abcdeé", "b": "bcdefg", "c": "\u65e5\u672c\u8a9e\u4e2d\u6587b"}
    text = lambda lang, n: " ".join("".join(r.choice(letters[lang]) for _ in range(r.choice([2, 3, 4, 70]))) for _ in range(n))
    train = [(lang, text(lang, 12)) for lang in "abc" * 8]
    model = langid.train(spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate(train)], "doc_id long, lang string, text string"))
    asked = [text(r.choice("abc"), r.randrange(1, 20)) + " " + text(r.choice("abc"), 2) for _ in range(60)] + ["b", "zzz", "B" * 200, "1 2", "q" * 70]
    got = langid.predict(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model, keep={"doc_id": "doc_id"}).collect()
    for x in got:
        lang, score = plain_language(train, asked[x.doc_id])
        assert x.lang_pred == lang and abs(x.score - score) < 1e-9, asked[x.doc_id]
    # Languages that were taught the same are a tie, which the first in order wins.
    same = langid.train(spark.createDataFrame([(1, "b", "ab cd"), (2, "a", "ab cd")], "doc_id long, lang string, text string"))
    assert [(x.lang_pred, x.score) for x in langid.predict(spark.createDataFrame([("ab xy",)], "text string"), same).collect()] == [("a", 0.5)]
    nothing = langid.train(spark.createDataFrame([(1, None, "ab")], "doc_id long, lang string, text string"))
    assert [(x.lang_pred, x.score) for x in langid.predict(spark.createDataFrame([("ab xy",)], "text string"), nothing).collect()] == [("und", 0.0)]


def test_class_model(spark):
    r = random.Random(2)
    first, second = ["ba", "be", "bi", "bo", "bu"], ["ka", "ke", "ki", "ko", "ku"]
    rows = [(i, " ".join(r.choice((first, second)[n % 2]) for n in range(30))) for i in range(200)] + [(500, "Ba unseen\tKE"), (501, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tokens = {i: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + ["\n"] for i, t in rows}
    train = Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(train.values()), len(train)
    # Few common words: the counts of the others come by the other way.
    for common in (400_000, 3):
        got = {x.doc_id: x for x in brown.score(df, classes=8, clustered=64, common=common).collect()}
        for i, t in tokens.items():
            assert abs(got[i].base_score - sum(math.log10((train[w] + 1) / (n + v + 1)) for w in t)) < 1e-9
            assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(t), sum(train[w] > 0 for w in t), n)
    held = [x for x in got.values() if x.held_out]
    assert held and sum(x.score for x in held) > sum(x.base_score for x in held) + 10


def test_class_scores_by_plain_counting(spark):
    """All but exchange() itself, which its own test looks at, counted over again in plain Python."""
    import numpy as np

    r, classes, clustered, least = random.Random(12), 6, 12, 3
    word = lambda kind: kind + str(int(r.random() ** 2 * 25)) + r.choice(["ab", "\u00e9b", "\u8a9ea"])
    rows = [(i, " ".join(word("n") + " " + word("v") + r.choice(["", " the"]) for _ in range(r.randrange(1, 20)))) for i in range(150)]
    rows += [(900, None), (901, "never seen words"), (902, "The\tN0AB v1ab")]
    got = {x.doc_id: x for x in brown.score(spark.createDataFrame(rows, "doc_id long, text string"), classes=classes, clustered=clustered, least=least).collect()}
    texts = {i: [w.encode() for w in re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()] + [brown.END] for i, t in rows}
    train = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(w for t in train for w in t)
    order = sorted(count, key=lambda w: (-count[w], brown.word_key(w)))
    alone = [brown.END, *[w for w in order if w != brown.END][: clustered - 1]]
    ending = lambda w: len(alone) + (brown.word_key(w) & 0xFF)
    unit = lambda w: alone.index(w) if w in alone else ending(w)
    square = np.zeros((len(alone) + brown.ENDINGS,) * 2)
    for t in train:
        for a, b in zip([brown.END, *t], t):
            square[unit(a), unit(b)] += 1
    of = brown.exchange(square, classes)
    table = np.zeros((classes, classes))
    for i, j in zip(*np.nonzero(square)):
        table[of[i], of[j]] += square[i, j]
    class_of = {w: int(of[unit(w)]) for w in count}
    smooth = table + 0.5
    own = dict(class_of)
    for w in count:
        if w not in alone and count[w] >= least:
            gain = np.zeros(classes)
            for t in train:
                for a, b, c in zip([brown.END, *t], t, t[1:]):
                    if b == w:
                        gain += np.log(smooth[class_of[a]] / smooth.sum(axis=0)) + np.log(smooth[:, class_of[c]] / smooth.sum(axis=1))
            best = np.flatnonzero(gain >= gain.max() - 1e-9)
            own[w] = int(best[0])
    assert sum(own[w] != class_of[w] for w in count) > 5
    of_any = lambda w: own[w] if w in own else int(of[ending(w)])
    table = np.zeros((classes, classes))
    for t in train:
        for a, b in zip([brown.END, *t], t):
            table[own[a], own[b]] += 1
    size = [sum(count[w] + 1 for w in count if own[w] == k) + 1 for k in range(classes)]
    for i, t in texts.items():
        total = 0.0
        for a, b in zip([brown.END, *t], t):
            a, k = of_any(a), of_any(b)
            weight = table[a].sum() / (table[a].sum() + brown.TRUST)
            follows = weight * table[a, k] / max(1, table[a].sum()) + (1 - weight) * (table[:, k].sum() + 1) / (table.sum() + classes)
            total += math.log10(follows * (count[b] + 1) / size[k])
        assert abs(got[i].score - total) < 1e-6, i


def test_endings_are_letters():
    assert brown.ending_of("caf\u00e9s".encode()) == "\u00e9s".encode() and brown.ending_of("\u65e5\u672c\u8a9e".encode()) == "\u672c\u8a9e".encode()
    assert brown.ending_of(b"cats") == b"ts" and brown.ending_of(b"a") == b"a" and brown.ending_of("\u8a9e".encode()) == "\u8a9e".encode()


def test_exchange_raises_likelihood():
    import numpy as np

    r = np.random.default_rng(1)
    square = r.poisson(0.3, (30, 30)).astype(float)
    square[:15, 15:] += 5
    square[15:, :15] += 5

    def likelihood(of):
        member = np.eye(4)[of]
        t = member.T @ square @ member
        return brown._xlogx(t).sum() - brown._xlogx(t.sum(0)).sum() - brown._xlogx(t.sum(1)).sum()

    start = np.minimum(np.argsort(np.argsort(-square.sum(0), kind="stable")), 3)
    found = brown.exchange(square, classes=4)
    assert likelihood(found) > likelihood(start)
    assert set(found[:15]).isdisjoint(found[15:])


def test_embedding_bounds_and_links(spark):
    import numpy as np

    r = np.random.default_rng(3)
    base = r.normal(size=(20, 16))
    x = np.concatenate([base, base + r.normal(scale=0.05, size=base.shape), base + r.normal(scale=0.12, size=base.shape)])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    q, s, e = embeddings.quantised(unit)
    about = embeddings.products(q, q) * np.outer(s, s)
    assert (np.abs(about - unit @ unit.T) <= (1 + e)[:, None] * e + (1 + e)[None, :] * e[:, None] + e[:, None] * e + 1e-12).all()
    rows = [(i, v.tolist(), int(i % 2)) for i, v in enumerate(x)]
    labels = [i % 2 for i in range(len(x))]
    pairs = [(i, j) for i in range(len(x)) for j in range(i) if labels[i] == labels[j] and unit[i] @ unit[j] >= 0.98]
    wanted, degree = roots(range(len(x)), pairs), Counter(k for p in pairs for k in p)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for tile in (2048, 4):
        got = {v.vec_id: (v.component_id, v.n_links) for v in embeddings.near_duplicates(df, tile=tile).collect()}
        assert got == {i: (wanted[i], degree[i]) for i in range(len(x))} and pairs


@pytest.mark.parametrize(
    "page, wanted",
    [
        ("<body><nav><a href=/>Home</a></nav><article><h1>Title</h1><p>One &amp; two<p>Three<br>four</article><footer>c</footer>", ["Title", "One & two", "Three four"]),
        ("<article><p>Body</p><section class='comments'><p>" + "I disagree with this a lot " * 9 + "</p></section><aside>More</aside></article>", ["Body"]),
        ("<div id=sidebar><p>" + "word " * 60 + "</p></div><main><p>x</p></main><div class='cookie-notice'>We use cookies</div>", ["x"]),
        ("<div><a href=a>A</a> <a href=b>B</a></div><div><h2>Head</h2><p>" + "long text " * 30 + "</p><p>short one.</p><p>" + "more text " * 30 + "</p></div><div><a href=c>C</a></div>", ["Head", ("long text " * 30).strip(), "short one.", ("more text " * 30).strip()]),
        ("<div class=site-header>Site</div><div id=content><div class='article-header'><h1>T</h1></div><p>Short.</p><div class=post-comments>c</div></div><p>" + "other text here " * 20 + "</p>", ["T", "Short.", ("other text here " * 20).strip()]),
        ("<article><form><p>Name</p><input></form><script>var t='<p>no</p>'</script><p title='a>b'>yes</p><!-- <p>no</p> --></article>", ["yes"]),
    ],
)
def test_main_text(page, wanted):
    assert pages.main_text(page, pages.grow(*pages.labelled())).split("\n\n") == wanted


def test_licenses(spark):
    rows = [
        (1, "intro\nReleased under the MIT License."), (2, "Licensed under CC BY-NC 4.0."), (3, "my driving licence is old"), (4, "\n".join(licenses.TEXTS["bsd"])), (5, "This work is licensed under the GNU General Public License, version 3.\nAll rights reserved."), (6, "nothing"),
        (7, "See the Apache License, Version 2.0 for the terms.\n\nLicensed under the Apache License, Version 2.0"),
    ]
    out = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {x.doc_id: x.families for x in out.collect()}
    assert got == {1: ["mit"], 2: ["cc-by-nc"], 3: [], 4: ["bsd"], 5: ["gpl", "proprietary"], 6: [], 7: ["apache"]}
    plan = out._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert all(0 <= x.probability <= 1 for x in out.select(F.col("probability")).collect())


@pytest.fixture(scope="module")
def licence_model(spark):
    return licenses.train(spark)


def plain_licences(model, text):
    """family, families, n_confirmed and n_unknown of a text, every paragraph scored."""
    at, none = {g: i for i, g in enumerate(model.grams)}, model.families.index("none")
    pairs_of = lambda words: {" ".join(p) for p in zip(words, words[1:])}
    words_of = lambda t: [w for w in re.split("[^a-z0-9]+", t.lower()) if w]
    known = [(f, pairs_of(words_of(t))) for f, texts in licenses.TEXTS.items() for t in [*texts, " ".join(texts)]]
    known += [(f, pairs_of(words_of(frame.format(n)))) for f, names in licenses.NAMES.items() for n in names for frame in licenses.FRAMES]
    sure, unknown, confirmed = [], 0, 0
    runs = [p for p in re.split(r"\n[ \t\r]*\n", text) if "\n" in p.strip(" ")]
    for paragraph in [*text.split("\n"), *runs]:
        words = words_of(paragraph)
        grams = {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}
        logits = [b + sum(model.weights[at[g]][k] for g in grams if g in at) for k, b in enumerate(model.intercepts)]
        best = max(range(len(logits)), key=lambda k: logits[k])
        probability = 1 / sum(math.exp(x - logits[best]) for x in logits)
        if best == none:
            continue
        family, own = model.families[best], pairs_of(words)
        shared = max([len(own & t) / min(len(own), len(t)) for f, t in known if f == family and own & t], default=0)
        if probability >= model.threshold and shared >= licenses.CONFIRMS:
            confirmed += 1
            sure.append((-round(probability, 9), family))
        else:
            unknown += 1
    return min(sure)[1] if sure else "unknown" if unknown else "none", sorted({f for _, f in sure}), confirmed, unknown


def test_licences_are_those_of_scoring_every_paragraph(spark, licence_model):
    r = random.Random(31)
    rows = [t for _, t in licenses.labelled()] + licenses.OTHERS
    parts = [w for t in rows for w in t.split()]
    texts = [*rows, "\n".join(licenses.TEXTS["mit"]), "", "\n\n", "Die Stadt ist mit der Bahn gut zu erreichen."]
    for _ in range(250):
        lines = [r.choice([r.choice(rows), " ".join(words(r, 12)), " ".join(r.choice(parts) for _ in range(r.randrange(1, 25))), "", "MIT", "mit dem Zug"]) for _ in range(r.randrange(1, 6))]
        texts.append("\n".join(lines))
    got = {x.doc_id: x for x in licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model=licence_model).collect()}
    for i, t in enumerate(texts):
        assert (got[i].family, got[i].families, got[i].n_confirmed, got[i].n_unknown) == plain_licences(licence_model, t), t
    assert got[len(rows)].families == ["mit"] and len({x.family for x in got.values()}) > 10


def test_held_out_names(licence_model):
    """Notices of names that the labelled table lacks."""
    held = [("mit", "The code is free under the MIT license terms."), ("gpl", "Distributed under the GNU GPL version 2 or later."), ("apache", "Released under the Apache License."), ("bsd", "Licensed under the BSD 2-Clause License."), ("cc-by", "Text is available under Creative Commons CC BY 2.0."), ("none", "The museum is open on Sundays, and the entry is free."), ("none", "Software for the new machines was written by a student.")]
    at = {g: i for i, g in enumerate(licence_model.grams)}
    for family, text in held:
        w = [x for x in re.split("[^a-z0-9]+", text.lower()) if x]
        grams = {" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)}
        logits = licence_model.intercepts + sum(licence_model.weights[at[g]] for g in grams if g in at)
        assert licence_model.families[int(logits.argmax())] == family, text


def test_notices_without_the_usual_words(spark, licence_model):
    docs = spark.createDataFrame([(2, licenses.TEXTS["proprietary"][2]), (3, "Released under BSD-3-Clause."), (4, "Released under Apache-2.0."), (5, "You may use it under MPL 2.0."), (6, "Released under MIT.")], "doc_id long, text string")
    got = {x.doc_id: x.family for x in licenses.license_scan(docs, model=licence_model).collect()}
    assert [got[i] for i in (2, 3, 4, 5, 6)] == ["proprietary", "bsd", "apache", "mpl", "mit"]


def test_tokens_are_taken_apart_alike(monkeypatch):
    import pyarrow as pa

    r = random.Random(41)
    texts = ["", " ", None, "a", " a  B\tc\r\n", "\x0b\x0cx\x85y\xa0z w", "ÀÉ İ ſ K", "x" * 50, "\x1cq\x1f"]
    texts += [r.choice([None, "".join(r.choice("aB é\t\n\x0b\xa0日") for _ in range(r.randrange(12)))]) for _ in range(400)]
    for portion in (1, 40, 10**6):
        monkeypatch.setattr(brown, "PORTION", portion)
        got = []
        for known, index, lengths in brown.encoded(pa.array(texts, pa.string())):
            tokens, at = [known[i] for i in index.tolist()], 0
            for n in lengths.tolist():
                got.append(tokens[at : at + n])
                at += n
            assert at == len(tokens)
        assert got == [[*brown.tokens_of(t or ""), brown.END] for t in texts]


def test_line_dedup_leaves_no_shuffles_and_few_checkpoints(spark):
    def left(df):
        found = []
        for d, _, names in os.walk(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")):
            found += [os.path.getsize(os.path.join(d, x)) for x in names if x.startswith("part-")]
        shuffles = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(found), sum(shuffles.apply(i).length() for i in range(shuffles.size()) if shuffles.apply(i).getName().startswith("shuffle_"))

    rows = [(i, "\n".join(hashlib.sha256(f"{i % 50} {j}".encode()).hexdigest() for j in range(20))) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    before = left(df)
    out = linededup.repeated(df)
    after = left(df)
    assert [x.n_dropped for x in out.orderBy("doc_id").collect()] == [0] * 50 + [20] * 450
    # Neither keys nor lines stay until the driver collects its garbage; what is returned is stored once.
    assert after[1] - before[1] < 50_000 and after[0] - before[0] < 500_000, (before, after)


def test_pieces_merged_side_by_side_are_those_merged_alone(monkeypatch):
    # Each rare piece was merged by itself, which took most of op5's time.
    import random

    from kinweave.llm import bpe
    from kinweave.llm.queries import word_bpe_path

    merges, r = bpe.Merges.load(word_bpe_path()), random.Random(3)
    pieces = [b"", b"a", "é漢".encode(), b"abab" * 40, b"aaaaaaa", bytes([255, 0, 255])]
    pieces += ["".join(r.choices("etaoinshrdlu0é漢", k=r.randrange(1, 50))).encode() for _ in range(3000)]
    wanted = [bpe.pack_ids(merges.encode(x)) if x else b"" for x in pieces]
    monkeypatch.setattr(bpe, "ROWS", 7)
    assert merges.encode_many(pieces) == wanted
    monkeypatch.setattr(bpe, "ROWS", 8_192)
    assert merges.encode_many(pieces) == wanted

"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on odd inputs."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from texlake.llm import ann, chat, components, langid, mixing, near_dedup, packing, quality_classifier, quality_rules, queries, toxicity, url_filters

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of river stone walks under a quiet moon while seven birds carry letters over green hills toward old towns and new roads".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in rows], DOCS)


ODD = [(1, None, None, None), (2, "", "en", "a"), (3, "   \n\t ", "en", None), (4, "x" * 70_000, "en", "a"), (5, "same words here and there again", "en", "b"), (5, "same words here and there again", "en", "b"), (None, "no name", "en", "b")]


@pytest.fixture(scope="module")
def odd(spark):
    clash = documents(spark, ODD).withColumn("score", F.lit("mine")).withColumn("class_id", F.lit(3)).withColumn("size", F.lit("s"))
    return clash


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


# --- 1, 3, 6: classifiers ------------------------------------------------------------------------------------------


def labelled(spark, make, n=400):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        y = i % 4 == 0
        rows.append((i, make(rng, y), "en", "s"))
        labels.append((i, int(not y), int(y)))
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held_out(df, labels, column):
    return [(r["score"], r[column], r["predicted"]) for r in df.where("held_out").join(labels, "doc_id").collect()]


def test_quality_held_out(spark):
    docs, labels = labelled(spark, lambda rng, bad: " ".join(w + "###" for w in prose(rng, 40).split()) if bad else prose(rng, 40))
    rows = held_out(quality_classifier.classify(docs, quality_classifier.train(docs, labels), 0.3), labels, "quality")
    assert len(rows) > 40 and sum(p == y for _, y, p in rows) / len(rows) > 0.95
    assert all(0 <= s <= 1 for s, _, _ in rows)


def test_toxicity_held_out_and_misspelled(spark):
    docs, labels = labelled(spark, lambda rng, bad: prose(rng, 30) + " you " + (rng.choice(["blockhead", "numbskull"]) + " " if bad else " ") + prose(rng, 10))
    model = toxicity.train(docs, labels)
    rows = held_out(quality_classifier.classify(docs, model, 0.5), labels, "toxic")
    assert all(p == y for _, y, p in rows)
    plain, wrong, quoted, clean = model.score(pa.array(["you blockhead", "you bl0ckhead", 'he said the word "blockhead" in a report', "you are kind"]))
    assert plain > quoted and wrong > 0.5 > clean


def test_one_clear_term_decides_at_any_length():
    rng = random.Random(21)
    terms = ["blockhead", "numbskull", "dunderpate", "lackwit", "nincompoop"]

    def abusive(n, k):  # toxic texts of the sample hold three terms each
        words = prose(rng, n).split()
        for term in rng.sample(terms, k):
            words.insert(rng.randrange(len(words)), term)
        return " ".join(words)

    y = np.array([i % 4 == 0 for i in range(600)], float)
    texts = pa.array([abusive(rng.randrange(20, 300), 3 * int(v)) for v in y])
    model = toxicity.fit(texts, y, np.ones(600))
    for n in (5, 300, 40_000):
        single, clean = [abusive(n, 1) for _ in range(5)], [prose(rng, n) for _ in range(5)]
        assert (model.score(pa.array(single)) > 0.5).all() and (model.score(pa.array(clean)) < 0.5).all()
    assert (model.score(pa.array([prose(rng, 300) + ' he said "blockhead" once ' + prose(rng, 300)])) < 0.5).all()


def test_levenshtein_automaton_against_brute_force():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    p = toxicity.ToxicityParams()
    lexicon = toxicity.Lexicon(["moron", "worthless", "scum", "stupid", "lowe*"], p)
    rng = random.Random(5)
    for _ in range(3000):
        word = rng.choice(["moron", "worthless", "scum", "stupid", "lower"])
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(word) + 1)
            word = word[:k] + rng.choice(["", rng.choice("morwths")]) + word[k + rng.randrange(2) :]
        fits = [(distance(word, e), k) for k, e in enumerate(lexicon.entries) if not e.endswith("*") and distance(word, e) <= lexicon.allowed(e)]
        stem = len(word) >= 4 and word.startswith("lowe")
        got = lexicon.find(word)
        assert got == (lexicon.entries.index("lowe*"), 0) if stem else got == ((min(fits)[1], min(fits)[0]) if fits else None)


def test_misspelled_forms_of_stems_and_short_terms():
    rng = random.Random(22)
    terms = ["idiot", "idiots", "idiotic", "idiocy", "idiotism", "scum"]
    y = np.array([i % 2 == 0 for i in range(400)], float)
    texts = pa.array([prose(rng, 30) + (f" {terms[i // 2 % 6]} " if v else " ") + prose(rng, 10) for i, v in enumerate(y)])
    lexicon = toxicity.Lexicon(toxicity.learn_lexicon(texts, y, toxicity.ToxicityParams()), toxicity.ToxicityParams())
    stem = next(e for e in lexicon.entries if e.endswith("*"))
    assert "idiocy".startswith(stem[:-1]) and lexicon.find("idiotes") == (lexicon.entries.index(stem), 0)
    for word, entry in (("id1ot", "idiot"), ("ldiot", "idiot"), ("id1ots", "idiots"), ("1diotic", "idiotic"), ("sc0m", "scum"), ("s*um", "scum"), ("scu1m", "scum")):
        assert lexicon.find(word) == (lexicon.entries.index(entry), 1), word
    assert lexicon.find("slum") is None and lexicon.find("sum") is None and lexicon.find("x1") is None


def test_quality_tables_against_the_network():
    rng = random.Random(33)
    texts = pa.array([prose(rng, rng.randrange(5, 80)) + (" ### %% aa" * (i % 3)) for i in range(300)])
    y = np.array([float(i % 3 > 0) for i in range(300)])
    network = quality_classifier.fit_network(texts, y, np.ones(300))
    others = pa.array(["", "one", "ONE two ### %%", prose(rng, 400), "x" * 5000, "\n \t", *texts.to_pylist()[:50]])
    assert np.abs(network.folded().score(others) - network.score(others)).max() < 1e-4


def test_language_table_against_averaged_subwords():
    rng = random.Random(34)
    p = langid.LangParams(buckets=1 << 12, epochs=2)
    texts = [prose(rng, 20) if i % 2 else " ".join("".join(rng.choice("äöüß") for _ in range(5)) for _ in range(20)) for i in range(120)]
    model = langid.fit(pa.array(texts), [f"l{i % 2}" for i in range(120)], p)

    def bucket(piece: bytes) -> int:
        rolling = 0
        for byte in piece:
            rolling = (rolling * 0x100000001B3 + byte + 1) % (1 << 64)
        return int(langid.mix64(np.array([(rolling + len(piece)) % (1 << 64)], np.uint64))[0] % np.uint64(p.buckets))

    def probabilities(text):
        rows = []
        for word in re.findall(r"[^\x20\x09-\x0D]+", text):
            core = re.sub(r"[\W\d_]+", "", word.lower())
            marked = f"<{core}>".encode() if core else b""
            rows += [model.table[bucket(marked[i : i + n])] for n in p.orders for i in range(len(marked) - n + 1)]
        z = (np.mean(rows, axis=0) + model.bias) / model.temperature
        z = np.exp(z - z.max())
        return z / z.sum()

    for text in [*texts[:10], "a", "Ö x 12 ###", prose(rng, 300)]:
        assert np.abs(model.probabilities(pa.array([text]))[0][0] - probabilities(text)).max() < 1e-4, text
    many = langid.LangModel(model.langs, np.ones((p.buckets, 12)), np.arange(24.0).reshape(12, 2), np.zeros(2), 1.0, 0.0, p)
    assert many.folded().out is None and np.allclose(many.folded().probabilities(pa.array(texts[:3]))[0], many.probabilities(pa.array(texts[:3]))[0])


def test_languages_with_long_texts_only_and_many_languages(spark):
    rng = random.Random(35)
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéèàñçøåæœ"
    words = {f"l{k}": ["".join(rng.choice(letters) for _ in range(6)) for _ in range(8)] for k in range(80)}
    rows = [(i, " ".join(rng.choice(words[f"l{i % 80}"]) for _ in range(3000 if i % 80 == 7 else 25)), f"l{i % 80}", "s") for i in range(1600)]
    out = langid.identify(documents(spark, rows), langid.train(documents(spark, rows), p=langid.LangParams(max_rows=1200, buckets=1 << 14, epochs=8))).collect()
    right = {r["doc_id"]: r["lang_pred"] == f"l{r['doc_id'] % 80}" for r in out}
    assert sum(right.values()) > 0.9 * len(right) and len({r["lang_pred"] for r in out}) == 80 and right[7] and right[87]


def test_labels_of_long_texts_only(spark):
    docs, labels = labelled(spark, lambda rng, bad: " ".join(w + "###" for w in prose(rng, 60).split()) if bad else prose(rng, 60), n=120)
    model = quality_classifier.train(docs, labels, quality_classifier.QualityParams(max_chars=150))
    assert model.constant is None and model.score(pa.array(["the### river###", "the river"]))[0] < 0.5


def test_language_held_out(spark):
    rng = random.Random(1)
    alphabets = {"aa": "abcdefg", "bb": "hijklmn", "cc": "äöüßéèà"}
    rows = [(i, " ".join("".join(rng.choice(alphabets[x]) for _ in range(5)) for _ in range(20)), x, "s") for i in range(300) for x in [rng.choice(list(alphabets))]]
    docs = documents(spark, [*rows, (900, "123 ###", "aa", "s"), (901, None, "aa", "s")])
    out = {r["doc_id"]: r for r in langid.identify(docs, langid.train(docs)).collect()}
    assert all(out[i]["lang_pred"] == lang for i, _, lang, _ in rows)
    assert out[900]["lang_pred"] == out[901]["lang_pred"] == "und" and out[901]["score"] == 0
    assert out[3]["held_out"] == (zlib.crc32(b"3") % 4 == 2)


def test_classifiers_on_odd_and_empty_tables(spark, odd, empty):
    labels = spark.createDataFrame([(2, 1, 0), (5, 0, 1), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    for module in (quality_classifier, toxicity):
        for docs in (odd, empty):
            for marks in (labels, labels.limit(0)):
                rows = quality_classifier.classify(docs, module.train(docs, marks), 0.3).collect()
                assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    for docs in (odd, empty):
        assert langid.identify(docs, langid.train(docs)).count() == docs.count()


# --- 2: packing -----------------------------------------------------------------------------------------------------

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check_pack(rows, texts, window):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    want = sorted(t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts)
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    got = []
    for parts in by_doc.values():
        ids = []
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == len(ids) and r["length"] > 0
            ids += np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == parts[0]["doc_tokens"]
        got.append(ids)
    assert sorted(got) == want
    padding = 0
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert 0 < at <= window
        padding += window - at if at & (at - 1) else 0
    return padding


def test_packing_round_trip(spark):
    rng = random.Random(2)
    texts = [prose(rng, rng.choice([3, 10, 50, 200])) for _ in range(300)] + ["", None, "  two  spaces ", "a\n b \n\n c", "<|endoftext|> x", "é😀 " * 500]
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]).repartition(3)
    p = packing.PackParams(window=256, block_tokens=9000)
    assert check_pack(packing.pack(docs, PATH, p).collect(), texts, 256) == 0


def test_packing_counts_are_paid_for():
    rng = np.random.default_rng(0)
    histogram = np.bincount(rng.integers(1, 256, 5000), minlength=257)
    combos, counts = packing.repeats(histogram, packing.PackParams(window=256))
    used = np.zeros_like(histogram)
    for combo, n in zip(combos, counts, strict=True):
        assert combo.sum() == 256
        for x in combo[combo > 0]:
            used[x] += n
    assert (used <= histogram).all() and used.sum() > 0.8 * histogram.sum()


def test_packing_odd_and_empty(spark, odd, empty):
    rows = packing.pack(odd.where("doc_id <> 5"), PATH).collect()
    assert check_pack(rows, [t for i, t, *_ in ODD if i not in (5, None)], 2048) == 0
    assert packing.pack(empty, PATH).count() == 0


def test_packing_repeated_and_null_ids(spark, odd):
    rows = packing.pack(odd, PATH).collect()
    text_of = {i: t for i, t, *_ in ODD}
    sequences, tokens = {}, {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        tokens.setdefault(r["doc_id"], []).append((r["start"], ids.tolist(), r["doc_tokens"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    for i, pieces in tokens.items():
        want = [*tokenizer.encode(text_of[i] or "", add_special_tokens=False).ids, 1]
        copies = sum(x[0] == i for x in ODD)
        assert {n for _, _, n in pieces} == {len(want)} and sum(len(ids) for _, ids, _ in pieces) == copies * len(want)
        assert all(ids == want[start : start + len(ids)] for start, ids, _ in pieces)
    assert set(tokens) == {i for i, *_ in ODD}
    assert not packing.in_order({"vocab": {"a": 0, "b": 1, "ab": 3, "ba": 2}, "merges": [["a", "b"], ["b", "a"]]})


# --- 4: chat --------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    rng = random.Random(4)
    signs = ["\\", "<|", "<|end|>", "\n", "a", "é", "<\\|", "|>", "### "]
    rows = [(c, t, rng.choice(["user", "assistant", None, "as\nsist<|"]), rng.choice([None, "", "".join(rng.choice(signs) for _ in range(9))])) for c in range(40) for t in range(rng.randrange(1, 9))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    out = {r["conv_id"]: r for r in chat.digests(turns).collect()}
    whole = {r["conv_id"]: r["formatted"] for r in chat.conversations(turns).collect()}
    for c in range(40):
        mine = [(role or "", text or "") for i, _, role, text in rows if i == c]
        loss = "".join(t for r, t in mine if r == "assistant")
        assert out[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in mine).encode()).hexdigest()
        assert (out[c]["loss_chars"], out[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert out[c]["n_turns"] == len(mine) and out[c]["formatted_chars"] == len(whole[c])
    assert chat.digests(turns.limit(0)).count() == 0


def test_chat_tied_turns_long_texts_null_ids_and_clashing_columns(spark):
    rows = [(1, 1, "user", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (1, None, "assistant", "first"), (2, 1, "assistant", "x<|" * 400_000), (None, 1, "user", "no name"), (None, 2, "assistant", "")]
    kind = "conv_id long, turn long, role string, text string"
    turns = spark.createDataFrame(rows, kind).withColumns({"piece": F.lit(7), "loss": F.lit("x"), "formatted_chars": F.lit(None)})
    out = {r["conv_id"]: r for r in chat.digests(turns.repartition(3)).collect()}
    texts = {1: [("assistant", "first"), ("user", "a"), ("user", "a"), ("user", "b")], 2: [("assistant", "x<|" * 400_000)], None: [("user", "no name"), ("assistant", "")]}
    for c, mine in texts.items():
        assert out[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in mine).encode()).hexdigest()
        assert out[c]["loss_sha256"] == hashlib.sha256("".join(t for r, t in mine if r == "assistant").encode()).hexdigest() and out[c]["n_turns"] == len(mine)
    assert len(out) == 3


# --- 5: urls --------------------------------------------------------------------------------------------------------


def test_urls_rules_and_aliases(spark):
    canonical = '<html><LINK href="{}" REL=canonical>'
    rows = [
        (1, "https://Example.ORG/es/1?x#y", None), (2, "http://a.com/fr/2", None), (3, "http://a.com/de/2", ""), (4, None, None), (5, "nothing", "x"),
        (6, "http://m.net/a", canonical.format("https://b.com/de/1")), (7, "http://m.net/b", '<meta http-equiv="refresh" content="0; url=http://m.net/a">'),
        (8, "http://c.com/fr/1", canonical.format("http://m.net/b")), (9, "http://n.net/x", canonical.format("https://b.com/de/9")), (10, "http://m.net/c", None), (10, "http://m.net/c", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rule", F.lit(0))
    out = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge(pages).collect()}
    assert out[1] == ("example.org", "/es/1", "example.org/es/", "block")
    assert out[2] == ("a.com", "/fr/2", "com/fr/", "allow") and out[3][3] == "block"
    assert out[4] == ("", "", None, "allow") == out[5]
    assert out[8][3] == "allow" and out[6][3] == out[7][3] == "allow"  # an alias is explicitly allowed
    assert out[9] == ("n.net", "/x", None, "block")
    assert url_filters.judge(pages).count() == len(rows) and url_filters.judge(pages.limit(0)).count() == 0


def test_urls_relative_targets_and_entities(spark):
    link, meta = '<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">'
    forms = {
        "http://a.com/p/x": (link, "/de/1"), "http://b.com/p/x": (meta, "/de/2"), "http://c.com/p/x": (link, "../de/3?a=1&amp;b=2"), "http://d.net/p": (link, "//d.com/de/4"),
        "http://e.net/p": (meta, "https://e.com/de/5?a=1&amp;b=2"), "http://f.net/p": (link, "//e.com/de/5?a=1&#38;b=2"), "http://g.net/p": (link, "http://g.com/de/6?a=1&copy=2"),
    }
    rows = [(k, url, form.format(target)) for k, (url, (form, target)) in enumerate(forms.items())]
    free = [(50, "http://h.net/p", link.format("/r?u=http://x.com/de/1")), (51, "http://i.net/p", link.format("mailto:x@a.com")), (52, "nothing", link.format("/de/1"))]
    # blocked only through a node that the decoded target must equal: the page at it has no rule, its own target has
    chain = [(60, "http://k.net/q?a=1&b=2", link.format("http://k.com/de/7")), (61, "http://l.net/q", link.format("//K.net/q?a=1&amp;b=2")), (62, "http://k.net/z", meta.format("q?a=1&amp;b=2"))]
    out = {r["page_id"]: r["verdict"] for r in url_filters.judge(spark.createDataFrame(rows + free + chain, "page_id long, url string, html string")).collect()}
    assert all(out[k] == "block" for k in range(len(rows))), out
    assert {out[k] for k in (50, 51, 52)} == {"allow"} and {out[k] for k in (60, 61, 62)} == {"block"}
    assert url_filters.resolve("https://a.com/x", "/y?a=1&copy=2&amp;b") == "http://a.com/y?a=1&copy=2&b"


def brute_judge(pages):
    """Verdicts by an HTML parser, urllib and a search through the links."""
    from html.parser import HTMLParser
    from urllib.parse import urljoin

    def node(url):
        host, tail = re.match(r"([^/?#]*)([^#]*)", url.split("://", 1)[1]).groups()
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail

    def rule(host, tail):
        path, best = re.split("[?#]", tail)[0], ("", None)
        for verdict, h, start in url_filters.RULES:
            if (host == h or host.endswith("." + h)) and path.startswith(start) and len(h + start) > len(best[0]):
                best = (h + start, verdict)
        return best[1]

    links = []
    for _, url, html in pages:
        class Links(HTMLParser):
            def handle_starttag(self, tag, attrs, url=url):
                a = dict(reversed(attrs))
                target = None
                if tag == "link" and (a.get("rel") or "").strip().lower() == "canonical":
                    target = a.get("href")
                if tag == "meta" and (a.get("http-equiv") or "").strip().lower() == "refresh":
                    target = (re.findall(r"(?i)url\s*=\s*(.+)$", a.get("content") or "") or [None])[0]
                if target and url and "://" in url and "://" in (whole := urljoin("http://" + url.split("://", 1)[1], target.strip(" \"'"))):
                    links.append((node(url), node(whole)))

        Links().feed(html or "")
    out = {}
    for k, url, _ in pages:
        own = rule(*node(url)) if url and "://" in url else None
        seen, todo = set(), [node(url)] if url and "://" in url else []
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += [b for a, b in links if a == x] + [a for a, b in links if b == x]
        verdicts = {rule(*x) for x in seen}
        out[k] = own or ("block" if "block" in verdicts and "allow" not in verdicts else "allow")
    return out


def test_urls_query_against_brute_force_and_sql(spark, tmp_path):
    rng = random.Random(51)
    hosts, paths = ["a.com", "b.com", "M.net", "n.net", "example.org", "c.net"], ["/de/1", "/fr/2", "/p/q", "/x", "/es/1", "/p/r/s", "", "/x?a=1&b=2", "/de/3?c=1"]
    targets = ["/x", "/p/q", "../x", "./q", "q", "//b.com/de/1", "//n.net/p/q", "https://a.com/de/1", "http://m.net/x?a=1&amp;b=2", "?a=1&amp;b=2", "mailto:x@y", "http://N.net/x#f", "/x?u=http://b.com/de/1"]
    forms = ['<link rel="canonical" href="{}">', "<LINK href='{}' REL='Canonical'>", '<meta http-equiv="refresh" content="0; url={}">', "<meta content='5;URL={}' http-equiv=Refresh>", '<link rel="stylesheet" href="{}">', '<a href="{}">']
    rows = [(k, f"http{'s' * (k % 2)}://{rng.choice(hosts)}{rng.choice(paths)}", "<html>" + "".join(rng.choice(forms).format(rng.choice(targets)) for _ in range(rng.randrange(3)))) for k in range(60)]
    rows += [(100, None, "<link rel=canonical href=/de/1>"), (101, "x", None), (102, "http://q.net/" + "y" * 200_000, "<p>" * 100_000 + '<link rel="canonical" href="https://a.com/de/1">')]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["verdict"] for r in queries.op5_url_filters(spark, str(tmp_path)).collect()}
    want = brute_judge(rows)
    assert got == want and 5 < sum(v == "block" for v in want.values()) < 50
    duckdb = pytest.importorskip("duckdb").connect()
    duckdb.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    said = {k: v for k, _, _, _, v in duckdb.execute("select page_id, host, path, rule, verdict from (" + queries.OP5_SQL + ")").fetchall()}
    assert said == want


@pytest.mark.parametrize("at_once", [0, 1 << 16])
def test_components_against_union_find(spark, at_once):
    rng = random.Random(6)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(7, 7), (None, 3)] + [(500 + k, 501 + k) for k in range(60)] + [(900, 901 + k) for k in range(50)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    out = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long"), at_once=at_once).collect()}
    assert out == {x: root(x) for x in parent}


# --- 7: near duplicates ------------------------------------------------------------------------------------------


def brute_similarity(a, b, k=5):
    def items(text):
        words, seen, out = (text or "").lower().split(), {}, []
        width = min(k, len(words))
        for i in range(len(words) - width + 1 if words else 0):
            run = tuple(words[i : i + width])
            seen[run] = seen.get(run, 0) + 1
            out.append((run, seen[run]))
        return out

    x, y = items(a), items(b)
    if not x or not y:
        return 0.0
    row = [0] * (len(y) + 1)
    for u in x:
        last = 0
        for j, v in enumerate(y, 1):
            last, row[j] = row[j], last + 1 if u == v else max(row[j], row[j - 1])
    return row[-1] / (len(x) + len(y) - row[-1])


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("crowd", [8, 40])
def test_near_duplicates_against_brute_force(spark, crowd):
    rng = random.Random(crowd)
    texts = []
    for _ in range(12):
        base = prose(rng, 60)
        texts += [base, base, *(edited(rng, base, rng.randrange(1, 4)) for _ in range(3)), edited(rng, base, 8)]
    base = prose(rng, 90)
    texts += [edited(rng, base, 1) for _ in range(crowd)] + [None, "", "one two", "one two", "one three", "A B c d e", "a b C d e"]
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    p = near_dedup.DedupParams(small_bucket=4, block=8)
    out = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs, p).collect()}
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if brute_similarity(texts[i], texts[j]) >= 0.8:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    assert {i: r["class_id"] for i, r in out.items()} == {i: root(i) for i in range(len(texts))}
    assert all(r["kept"] == (r["class_id"] == i) for i, r in out.items())
    assert near_dedup.keep_one(docs, p).count() == len({root(i) for i in range(len(texts))})


def test_near_duplicates_move_little_of_large_groups(spark):
    rng = random.Random(8)
    base = prose(rng, 1500).split()
    texts = []
    for i in range(30):
        words = list(base)
        for _ in range(i):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        texts.append(" ".join(words))
    texts += [prose(rng, 40), None, "Ümläut \U0001d54f words"]
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    p = near_dedup.DedupParams()
    c = near_dedup.classes_of(docs, p)
    seqs = near_dedup.sequence_table(docs, c.classes.select("node", "doc_id", "h1", "h2"), c, p)
    nodes = {r["doc_id"]: r["node"] for r in c.classes.collect()}
    sent = {r["node"]: bytes(r["seq"]) for r in seqs.collect()}
    assert len(sent) == len(nodes) == 32
    for i, node in nodes.items():
        want = next(near_dedup.sequences(pa.array([texts[i]]), p.k))
        assert (next(near_dedup.unpack(pa.array([sent[node]], pa.binary()), p.k)) == want).all()
    assert sum(len(sent[nodes[i]]) for i in range(30)) < 0.6 * sum(len(texts[i]) for i in range(30))
    slices = list(near_dedup.runs(pa.array(list(sent.values()), pa.binary()), limit=1000))
    assert [k for s in slices for k in range(s.start, s.stop)] == list(range(32))
    # the smallest partner of 3 is unlike it and goes first; the pair behind it must still be compared
    own = spark.createDataFrame([(-1 if i == 30 else i, sent[node]) for i, node in nodes.items()], "node long, seq binary")
    for pairs in ([(-1, 3), (1, 3)], [(-1, 3), (1, 3), (1, 2), (2, 3), (-1, 32)]):
        found = near_dedup.linked(spark.createDataFrame(pairs * 2, "a long, b long"), own, p).toDF("node", "component").collect()
        assert dict(found) == dict.fromkeys({b for _, b in pairs} - {32} | {1}, 1)


def test_near_duplicates_odd_and_empty(spark, odd, empty):
    out = near_dedup.near_duplicates(odd).collect()
    assert len(out) == len(ODD) and sum(r["kept"] for r in out) == len(ODD) - 1
    assert near_dedup.near_duplicates(empty).count() == 0
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 1  # doc 5 stands there twice


def test_near_duplicates_of_repeated_and_null_ids(spark):
    rng = random.Random(70)
    base, other = prose(rng, 60), prose(rng, 50)
    near = edited(rng, base, 1)
    rows = [(1, near, "en", "a"), (2, "a first text of the id", "en", "a"), (2, base, "en", "b"), (3, other, "en", "a"), (3, other, "en", "a"), (3, other.upper(), "en", "a")]
    rows += [(4, "words of its own here and now", "en", "a"), (4, other, "en", "c"), (None, near, "en", "a"), (None, "nobody names this text at all", "en", "a"), (None, "nobody names this text at all", "en", "a"), (4, "", "en", "a"), (4, "", "en", "a")]
    docs = documents(spark, rows).withColumn("row", F.lit(1)).withColumn("f", F.create_map(F.lit("k"), F.lit(2))).withColumn("h1", F.lit("x"))
    out = near_dedup.near_duplicates(docs).collect()
    assert sorted((r["doc_id"] or 0, r["class_id"] or 0, r["kept"]) for r in out) == sorted(
        [(1, 1, True), (2, 2, True), (2, 1, False), (3, 3, True), (3, 3, False), (3, 3, False), (4, 4, True), (4, 3, False), (0, 1, False), (0, 0, True), (0, 0, False), (4, 4, True), (4, 4, True)]
    )
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted((r["doc_id"] or 0, r["text"].lower()) for r in kept.collect())
    want = [(1, near), (2, "a first text of the id"), (3, other), (4, "words of its own here and now"), (0, "nobody names this text at all"), (4, ""), (4, "")]
    assert got == sorted(want)


def test_crowded_buckets_lose_no_link(spark):
    """Families around common passages, of many lengths, in blocks much smaller than the families."""
    rng = random.Random(71)
    passage, texts = prose(rng, 30), []
    for _ in range(12):
        own = prose(rng, rng.randrange(6, 60))
        base = f"{passage} {own}" if rng.random() < 0.7 else f"{own} {passage}"
        texts += [edited(rng, base, rng.randrange(0, 4)) for _ in range(rng.randrange(1, 6))]
    texts += [edited(rng, texts[0], rng.randrange(1, 5)) for _ in range(30)]
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    linked = {(i, j) for i in range(len(texts)) for j in range(i) if brute_similarity(texts[i], texts[j]) >= 0.8}
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in linked:
        parent[max(root(i), root(j))] = min(root(i), root(j))
    for p in (near_dedup.DedupParams(small_bucket=2, block=3), near_dedup.DedupParams(small_bucket=2, block_kmers=100)):
        out = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs, p).collect()}
        assert out == {i: root(i) for i in range(len(texts))}


# --- 8: quality rules ------------------------------------------------------------------------------------------------


def brute_metrics(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, lines = {}, [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    hit = {i + j for at in seen.values() if len(at) > 1 for i in at for j in range(3)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))


def test_quality_rules_against_brute_force(spark, odd, empty):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("ab c# $d e\n é A!".split(" ")) for _ in range(rng.randrange(90))) for _ in range(150)] + ["a a a a a", "a b c", "x\ny\n\nx\n \n", None]
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]).withColumn("n_words", F.lit(-1))
    cascade = quality_rules.Cascade().fit(docs)
    assert len(cascade.estimates) == len(quality_rules.CASCADE)
    for r in cascade.apply(docs).collect():
        n_words, word_chars, n_symbols, dup, rep = brute_metrics(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n_words, word_chars, n_symbols, dup, rep), texts[r["doc_id"]]
        assert r["base_failed"] == (n_words < 50 or 100 * rep > 50 * n_words) and not (r["kept"] and r["base_failed"])
    assert {r["doc_id"]: r["kept"] for r in cascade.apply(docs).collect()} == {r["doc_id"]: r["kept"] for r in quality_rules.Cascade().apply(docs).collect()}
    assert quality_rules.Cascade().fit(odd).apply(odd).count() == len(ODD)
    assert quality_rules.Cascade().fit(empty).apply(empty).count() == 0


def test_cascade_orders_by_rejection_per_cost(spark):
    rng = random.Random(88)
    docs = documents(spark, [(i, prose(rng, 80) + " !" * (i % 2), "en", "s") for i in range(300)])
    ends = lambda m: F.col("_text").endswith("!")
    dear = lambda m: ends(m) & (F.length(F.sha2(F.repeat("_text", 40), 512)) > 0)
    rules = [quality_rules.Rule("dear", dear), quality_rules.Rule("never", lambda m: m("n_words") < 0), quality_rules.Rule("cheap", ends), quality_rules.Rule("dear_too", dear)]
    cascade = quality_rules.Cascade(tuple(rules)).fit(docs)
    cost, share = zip(*[cascade.estimates[r.name] for r in rules], strict=True)
    assert cost[0] > 5 * cost[2] and cost[3] > 5 * cost[2] and 0.3 < cost[0] / cost[3] < 3, cost
    assert abs(share[0] - 0.5) < 0.15 and share[0] == share[2] and share[1] == 0
    assert cascade.rules[0].name == "cheap" and cascade.rules[-1].name == "never"
    assert cascade.apply(docs).where("rejected_by = 'cheap'").count() == 150


# --- 9: nearest neighbours -----------------------------------------------------------------------------------------


def test_nearest_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[1000:1800] = x[5]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] * 16), (3003, [1.0, None] * 8), (3004, [1.0]), (None, x[0].tolist())]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    p = ann.AnnParams(block=500, query_group=7)
    out = ann.search(vectors, lambda v: v % 100 == 0, p).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    found = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        want = sorted((d[i], i) for i in range(3000) if i != q)[:10]
        assert got[q] == sorted(got[q]) and len(got[q]) == 10
        assert all(math.isclose(s, d[i], abs_tol=1e-12) for s, i in got[q])
        found += len({i for _, i in want} & {i for _, i in got[q]})
    assert found / 300 >= 0.9 and set(got) == set(range(0, 3000, 100))
    assert [i for _, i in got[1000]] == [5, *range(1001, 1010)]
    assert ann.search(vectors.limit(0), lambda v: v % 100 == 0).count() == 0


def test_nearest_neighbours_repeated_ids_and_few_in_lists(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 8))
    x[:5] += 40  # far from all others: their lists hold fewer than ten
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, x[100].tolist()), (100, x[7].tolist()), (0, (x[0] + 0.01).tolist())]
    rows += [(200, [1.0, 2.0]), (2000, [1.0, 2.5]), (2001, [2.0, 2.0]), (2002, [9.0]), (300, [3.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    p = ann.AnnParams(list_rows=30, min_probe=1, target_recall=0.5)
    got = {}
    for r in ann.search(vectors, lambda v: v % 100 == 0, p).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], round(r["score"], 9), r["vec_id"]))

    def brute(k):
        q = np.array(rows[k][1])
        near = sorted((round(float(np.sqrt(((np.array(v) - q) ** 2).sum())), 9), i) for j, (i, v) in enumerate(rows) if j != k and len(v) == len(q))
        return [(rank, *x) for rank, x in enumerate(near[:10], 1)]

    for q in {i for i, _ in rows if i % 100 == 0}:
        mine = [brute(k) for k, (i, _) in enumerate(rows) if i == q]
        assert len(got[q]) == sum(map(len, mine)), q
    assert sorted(got[0])[:8] == sorted(brute(0) + brute(902))[:8]  # the near ones; the far ones are approximate
    assert (1, 0.5, 2000) in got[200] and (2, 1.0, 2001) in got[200]
    assert got[300].count((1, 6.0, 2002)) == 1 and (1, 0.0, 100) in got[100]


# --- 10: mixing --------------------------------------------------------------------------------------------------------


def fill(sizes, weights, total):
    """Targets by resharing the excess over caps until none is above."""
    target, open_, left = dict.fromkeys(sizes, 0.0), set(sizes), total
    while open_:
        w = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / w > 2 * sizes[s] + 1e-9}
        if not over:
            return target | {s: left * weights[s] / w for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mixing_targets_and_positions(spark, empty):
    rng = random.Random(9)
    rows = [(i, rng.choice([prose(rng, rng.randrange(1, 40)), None, ""]), "en", rng.choice(["b", "a", "ä", "Z", None, "b", "b"])) for i in range(400)]
    docs = documents(spark, rows).withColumn("target", F.lit("x"))
    out = mixing.mix(docs).collect()
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = fill(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    taken = dict.fromkeys(sizes, 0)
    for r in out:
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9) and r["source_size"] == sizes[r["source"]]
        assert list(r["positions"]) == sorted(r["positions"]) and all(0 <= x <= 1.5 * sum(sizes.values()) * (1 + 1e-9) for x in r["positions"])
        assert 0 <= r["taken"] <= 2 * r["size"] and len(r["positions"]) == (r["taken"] > 0) + (r["taken"] > r["size"])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    applied = mixing.apply_mix(documents(spark, rows))
    assert applied.columns == documents(spark, rows).columns and applied.count() == sum(len(r["positions"]) for r in out)
    assert mixing.mix(empty).count() == 0 and mixing.apply_mix(empty).count() == 0


def test_demand_is_inverted(spark):
    t = spark.range(101).select((F.col("id") / 100).alias("t"))
    share = (1.5 * F.col("t") - 0.5 * F.col("t") ** 2) / 1.0
    back = t.select("t", mixing.invert_demand(share, F.lit(1.5), F.lit(0.5)).alias("b")).collect()
    assert all(math.isclose(r["t"], r["b"], abs_tol=1e-9) for r in back)


def test_mixing_odd(spark, odd):
    out = mixing.mix(odd).collect()
    assert len(out) == len(ODD) and all(r["taken"] <= 2 * r["size"] for r in out)
    assert mixing.apply_mix(odd).columns == odd.columns

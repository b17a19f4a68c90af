"""Near-duplicates, URL filter, toxicity, quality, language model: brute force, invariants, held-out accuracy, odd input."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from pixelloom.llm import boosting, maxent, quality, simhash, tokens, toxicity, url_filter


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, radius=2):
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, fp, least.get(find(i))) for i, (d, fp) in enumerate(rows)), key=repr)


def near_texts():
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    texts = []
    for _ in range(120):
        words = list(base)
        for _ in range(rng.randrange(3)):
            words[rng.randrange(400)] = f"c{rng.randrange(9)}"
        texts.append(" ".join(words))
    return texts


def test_near_duplicates_match_brute_force(odd_docs, docs_of, spark, monkeypatch):
    alone = spark.createDataFrame([(None, "a text that only a null id has got"), (None, "and another one of the kind")], "doc_id long, text string")
    for docs, block in ((odd_docs.select("doc_id", "text").unionByName(alone), 1024), (docs_of(near_texts()), 8)):
        monkeypatch.setattr(simhash, "BLOCK", block)
        rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
        got = sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=repr)
        assert got == brute_components(rows)


def test_tiles_of_any_parts(docs_of, spark):
    """All numbers of parts link the same, also at the ends of the counts; steps are half of all that are near."""
    for parts, n in ((4, 41), (8, 145), (16, 545)):
        steps = set(simhash._steps(parts, 2))
        assert len(steps) == (n + 1) // 2 and 0 in steps
    rng, full = random.Random(6), (1 << 64) - 1
    prints = {0, full, 1, 3, full ^ 1, full ^ 1 << 63, 1 << 63}
    for _ in range(60):
        x = rng.getrandbits(64)
        prints |= {x, *(x ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(3))}
    prints = sorted(prints)
    rows = spark.createDataFrame([(f - (f >> 63 << 64), i) for i, f in enumerate(prints)], "fp long, node long")
    want = [c for _, _, c in sorted(brute_components(list(enumerate(prints))))]
    for parts in (4, 8, 16):
        component = list(range(len(prints)))
        for _ in range(3):
            for r in simhash.near_links(rows, 2, parts).collect():
                a, b = sorted((component[r.u], component[r.v]))
                component = [a if c == b else c for c in component]
        assert component == want


def test_keep_first(odd_docs, no_docs):
    kept = simhash.keep_first(odd_docs).collect()
    found = simhash.near_duplicates(odd_docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted({r.component_id for r in found})
    assert simhash.keep_first(no_docs).count() == 0 and simhash.near_duplicates(no_docs).count() == 0


def brute_rule(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        tail = rest[end:]
        path = tail[: min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))]
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


def test_url_filter(spark):
    good = [f"http://a.org/news/{i}.html" for i in range(200)]
    bad = [f"http://a.org/spam/{i}.html" for i in range(200, 400)]
    odd = ["http://WWW.Example.COM/en/1", "https://example.com/en/2?x", "https://badexample.com/en/", "x://h.net/es/a/b/c/d/e/f/g/h/i/j", "a://b#c/d", None, "", "no scheme", "://", "http://h?q#/", "http://É.net/fr/9", "http://com/"]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate([*good, *bad, *odd, odd[0]])], "page_id long, url string, verdict string")
    labels = spark.createDataFrame([(i, int(i < 200)) for i in range(400)] + [(None, 1), (7, None)], "doc_id long, quality int")
    rows = url_filter.judge_urls(pages, labels).collect()
    assert len(rows) == pages.count()
    for r in rows:
        host, path, rule, verdict = brute_rule(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.url in bad else "allow")), r
    assert {r.template for r in rows if r.url in bad} == {"/spam/~"}
    none = url_filter.judge_urls(pages, labels.limit(0)).where("rule is null and verdict = 'block'")
    assert none.count() == 0
    assert url_filter.judge_urls(pages.limit(0), labels).count() == 0


def plain_tree(urls):
    """{(host, path): (template, purity)} of (host, path, label or None), by recursion over each host's paths."""
    paths = {}
    for host, path, label in urls:
        n, labelled, good = paths.get((host, path), (0, 0, 0))
        paths[host, path] = n + 1, labelled + (label is not None), good + (label or 0)
    cut = {k: [re.sub("[0-9]+", "#", part) for part in k[1].split("/")[1:]] for k in paths}
    named, waiting = {}, [(host, "", 0, [k for k in paths if k[0] == host]) for host in {h for h, _ in paths}]
    total = lambda keys: [sum(paths[k][i] for k in keys) for i in range(3)]
    while waiting:
        host, template, depth, keys = waiting.pop()
        named |= {k: template for k in keys if len(cut[k]) <= depth}
        keys = [k for k in keys if len(cut[k]) > depth]
        all_n, all_labelled, all_good = total(keys)
        if all_n < url_filter.MIN_COUNT:
            named |= {k: template + "/*" * (len(cut[k]) - depth) for k in keys}
            continue
        after, p = {}, (all_good + 0.5) / (all_labelled + 1)
        for segment in {cut[k][depth] for k in keys}:
            mine = [k for k in keys if cut[k][depth] == segment]
            n, labelled, good = total(mine)
            frequent = n >= url_filter.MIN_COUNT and n >= url_filter.MIN_SHARE * all_n
            enough = n >= url_filter.MIN_COUNT and labelled >= url_filter.MIN_LABELS
            z = abs(good / labelled - p) / (p * (1 - p) / labelled) ** 0.5 if labelled else 0
            part = segment if (frequent or enough) and z > url_filter.MERGE_Z else "~" if frequent else "*"
            after.setdefault(f"{template}/{part}", []).extend(mine)
        waiting += [(host, t, depth + 1, ks) for t, ks in after.items()]
    smooth = lambda keys, prior: (total(keys)[2] + url_filter.SMOOTHING * prior) / (total(keys)[1] + url_filter.SMOOTHING)
    overall = (total(paths)[2] + 1) / (total(paths)[1] + 1)
    hosts, groups = {}, {}
    for k, template in named.items():
        hosts.setdefault(k[0], []).append(k)
        groups.setdefault((k[0], template), []).append(k)
    purity = {g: smooth(ks, smooth(hosts[g[0]], overall)) for g, ks in groups.items()}
    return {k: (t, purity[k[0], t]) for k, t in named.items()}


def test_template_tree_equals_plain_recursion(spark):
    rng = random.Random(6)
    sections = {"a.com": [("news", 0.9), ("shop", 0.1), ("blog", 0.9), ("wiki", 0.85)], "b.org": [(f"s{chr(97 + i)}", 0.05 if i % 9 == 0 else 0.8) for i in range(26)], "c.net": [("x", 0.5)]}
    urls = []
    for host, parts in sections.items():
        for _ in range(700):
            section, share = rng.choice(parts)
            tail = rng.choice([f"{rng.randrange(50)}", f"{rng.choice('pqr')}/{rng.randrange(9)}", f"item-{rng.randrange(10**6)}.html", f"{''.join(rng.choices('uvw', k=3))}/deep/{rng.randrange(30)}", ""])
            label = int(rng.random() < share) if rng.random() < 0.6 else None
            urls.append((host, f"/{section}/{tail}", label))
    urls += [("few.io", "/a/b/1", 1), ("few.io", "/a/c", None), ("few.io", "", 0), ("", "", None)]
    want = plain_tree(urls)
    frame = spark.createDataFrame([(h, p, int(x is not None), x or 0) for h, p, x in urls], "host string, path string, labelled long, good long").repartition(5)
    found = {(r.host, r.path): (r.template, r.purity) for r in url_filter.path_templates(frame).collect()}
    assert {k: t for k, (t, _) in found.items()} == {k: t for k, (t, _) in want.items()}
    assert {k: round(p, 9) for k, (_, p) in found.items()} == {k: round(p, 9) for k, (_, p) in want.items()}
    templates = {t for t, _ in want.values()}
    assert any("~" in t for t in templates) and any("/shop" in t for t in templates) and min(p for _, p in want.values()) < url_filter.MIN_PURITY


def test_url_filter_tells_small_and_deep_sections(spark):
    """One of 60 equal sections is bad; so is one section below the tenth segment, beside a good one."""
    deep = "/".join("abcdefghij")
    urls = [(f"http://many.org/section-{chr(97 + s // 26)}{chr(97 + s % 26)}/{i}", s != 33) for s in range(60) for i in range(s * 100, s * 100 + 100)]
    urls += [(f"http://deep.org/{deep}/{'good' if i % 2 else 'bad'}/{i}", bool(i % 2)) for i in range(6000, 6400)]
    urls.append(("http://deep.org/" + "x/" * 300, True))
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(good)) for i, (_, good) in enumerate(urls[:-1])], "doc_id long, quality int")
    rows = url_filter.judge_urls(pages, labels).collect()
    assert len(rows) == len(urls)
    assert {r.url for r in rows if r.verdict == "block"} == {u for u, good in urls if not good}


def toxic_corpus(n=1200):
    rng = random.Random(5)
    common = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(common) for _ in range(rng.randint(20, 200))]
        y = int(i % 6 == 0)
        if y:
            for _ in range(max(2, len(words) // 40)):
                words.insert(rng.randrange(len(words)), rng.choice(["vile!", "Nasty", "rotten"]))
        rows.append(" ".join(words))
        labels.append((i, 1, y))
    return rows, labels


def test_toxicity_held_out(spark, docs_of, odd_docs, no_docs):
    texts, labels = toxic_corpus()
    docs, known = docs_of(texts), spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, known)
    scored = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    held = [(scored[i].predicted, y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(p for p, y in held if y) >= 0.95 * sum(y for _, y in held)
    assert sum(p for p, y in held if not y) <= 0.02 * len(held)
    odd = toxicity.score_toxicity(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in odd)
    assert {r.predicted for r in odd if r.doc_id in (0, 1, 2)} == {0}
    assert toxicity.score_toxicity(no_docs, model).count() == 0
    blank = toxicity.train(no_docs, known.limit(0))
    assert len({r.score for r in toxicity.score_toxicity(docs, blank).collect()}) == 1


def plain_kneser_ney(texts, toxic):
    """The same models with dictionaries of words and pairs. Returns the evidence of a text, and P_c(word | word before) for all words."""
    d, split = toxicity.DISCOUNT, lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").lower())
    words = [split(t) for t in texts]
    pairs_of = lambda ws: list(zip([None, *ws], ws, strict=False))
    stems_of = lambda w: [w[:n] for n in reversed(toxicity.BEGINNINGS) if len(w) > n]
    kinds = {"word": lambda ws: ws, "pair": pairs_of, "stem": lambda ws: [s for w in ws for s in stems_of(w)]}
    count, untied, docs = {}, {}, Counter(toxic)
    for kind, of in kinds.items():
        count[kind], held = Counter(), Counter()
        for ws, y in zip(words, toxic, strict=True):
            count[kind].update((e, y) for e in of(ws))
            held.update((e, y) for e in set(of(ws)))
        untied[kind] = set()
        for e in {e for e, _ in held}:
            stat, n = 0.0, held[e, 0] + held[e, 1]
            for y in (0, 1):
                for seen, row in ((held[e, y], n), (docs[y] - held[e, y], docs.total() - n)):
                    stat += 2 * seen * math.log(seen * docs.total() / (row * docs[y])) if seen else 0
            if stat >= toxicity.LEAST_APART:
                untied[kind].add(e)
    vocabulary = {w for w, _ in count["word"]}
    stem = lambda w: next((s for s in stems_of(w) if s in untied["stem"]), "")
    own, tied = vocabulary & untied["word"], vocabulary - untied["word"]
    left = Counter(w for _, w in {e for e, _ in count["pair"]})
    total = [sum(n for (_, y), n in count["word"].items() if y == c) for c in (0, 1)]
    mass = Counter()
    for w in tied:
        for c in (0, 1):
            mass[stem(w), c] += count["word"][w, c]
    untied["stem"] = {stem(w) for w in tied} - {""}  # those that tied words have; an unknown word goes to the longest of them
    stems = [*untied["stem"], ""]
    pooled = {s: mass[s, 0] + mass[s, 1] + 1.0 for s in stems}
    part = d * len(own) / max(1, d * len(own) + sum(pooled.values()))

    def single(w, c):
        rest = max(1e-9, 1 - sum(max(0, count["word"][x, c] - d) / total[c] for x in own))
        if w in own:
            return max(0, count["word"][w, c] - d) / total[c] + rest * part * (left[w] + 1) / sum(left[x] + 1 for x in own)
        s, weight = stem(w), toxicity.SHARED
        p = (mass[s, c] + weight * pooled[s] / sum(pooled.values())) / (sum(mass[x, c] for x in stems) + weight)
        mates = [x for x in tied if stem(x) == s]
        every, follows = sum(count["word"][x, 0] + count["word"][x, 1] for x in mates), sum(left[x] for x in mates)
        unknown = d * len(mates) / (follows + 1) / every if mates else 1.0
        inside = (count["word"][w, 0] + count["word"][w, 1] - d + d * len(mates) * left[w] / (follows + 1)) / every if w in tied else unknown
        return rest * (1 - part) * p * inside

    def after(v, w, c, cache={}):
        n = max(1, count["word"][v, c])
        share = lambda x: max(0, count["pair"][(v, x), c] - d) / n
        rest = 1 - sum(share(x) for u, x in untied["pair"] if u == v)
        if (w, c) not in cache:
            cache[w, c] = single(w, c)
        return (share(w) if (v, w) in untied["pair"] else 0) + rest * cache[w, c]

    def evidence(text):
        ws = split(text)
        plain = math.log(single("", 1) / single("", 0))
        return sum(math.log(after(v, w, 1) / after(v, w, 0)) for v, w in pairs_of(ws)) / len(ws) - plain if ws else 0.0

    return evidence, after, vocabulary, untied, stems


def test_toxicity_equals_plain_kneser_ney(spark, docs_of, monkeypatch):
    monkeypatch.setattr(toxicity, "LEAST_APART", 8.0)
    rng, texts, labels = random.Random(8), [], []
    for i in range(160):
        ws, y = [rng.choice(["alpha", "beta", "gamma", "delta", "words", "größer", "größte"]) for _ in range(12)], i % 2
        ws += [rng.choice(["vile", "nasty"])] * y + [rng.choice(["scoundrels", "scoundrelly", "scoundrelish", "scoun" + str(i)])] * (y or i % 9 == 0)
        ws.insert(3, "utterly alpha" if y and i % 3 else "alpha utterly")
        texts.append(" ".join(ws))
        labels.append((i, y))
    docs = docs_of(texts)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    fold = [zlib.crc32(str(i).encode()) % 4 for i in range(160)]
    counted = [i for i in range(160) if fold[i] in (0, 1)]
    evidence, after, vocabulary, untied, stems = plain_kneser_ney([texts[i] for i in counted], [labels[i][1] for i in counted])
    assert untied["word"] and untied["pair"] and untied["stem"]
    assert (len(model.words), len(model.pairs), len(model.stems)) == tuple(len(untied[k]) + 1 for k in ("word", "pair", "stem"))
    asked = [*texts[:30], None, "", "unknown scoundrelicious words", "utterly alpha utterly unheard"]
    assert model.evidence(pa.array(asked)).tolist() == pytest.approx([evidence(t) for t in asked], abs=1e-9)
    # an unknown word stands for all unknown ones of its beginning; shorter and longer unknown ones have the same share
    unknown = ["?", *(s + "~~~~~" for s in stems if s and not any(t != s and t.startswith(s) for t in stems))]
    within = {s + "~~~~~" for s in stems if s} - set(unknown)
    for v in ("utterly", "alpha", "never seen"):
        for c in (0, 1):
            assert sum(after(v, w, c) for w in [*vocabulary, *unknown, *within]) == pytest.approx(1, abs=1e-6)


def brute_stats(text):
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    lines = [line for line in (text or "").split("\n") if line.strip(" \t\x0b\x0c\r")]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) for k in range(3) if windows[tuple(words[i : i + 3])] > 1}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_stats_and_verdicts(spark, docs_of, odd_docs, no_docs):
    rng = random.Random(1)
    fine = [" ".join(f"w{rng.randrange(900)}" for _ in range(120)) for _ in range(60)]
    junk = [" ".join(f"W{rng.randrange(900)}###" for _ in range(120)) for _ in range(60)]
    docs = docs_of([*fine, *junk])
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(0, 120, 2)] + [(None, 1)], "doc_id long, quality int")
    trees = quality.fit_quality(docs, labels)
    rows = {r.doc_id: r for r in quality.quality_rules(docs, trees).collect()}
    assert all(rows[i].kept == (i < 60) for i in rows)
    for r in quality.quality_rules(odd_docs, trees).collect():
        n, chars, symbols, dup, repeat = brute_stats(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n) and not (r.base_failed and r.kept)
    assert quality.quality_rules(no_docs, quality.fit_quality(no_docs, labels)).count() == 0


def test_quality_of_repeated_and_named_ids(spark, docs_of):
    rng = random.Random(1)
    made = [" ".join(f"w{rng.randrange(900)}" + "###" * (i % 2) for _ in range(120)) for i in range(80)]
    docs = docs_of(made).unionByName(docs_of(made[::-1]))  # every id with two texts, a good and a bad one
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(80)], "doc_id long, quality int")
    first, again = (quality.fit_quality(x, labels) for x in (docs, docs.repartition(7, "text")))
    assert all(np.array_equal(getattr(first, n), getattr(again, n)) for n in ("feature", "threshold", "value"))
    named = lambda x: x.withColumn("doc_id", F.format_string("id%03d", F.col("doc_id")))  # noqa: E731  in the same order
    by_name = quality.fit_quality(named(docs), named(labels))
    assert np.array_equal(by_name.feature, first.feature) and np.array_equal(by_name.value, first.value)
    assert quality.quality_rules(named(docs), by_name).where("doc_id like 'id0%'").count() == 160


def test_trees_respect_constraints():
    rng = np.random.default_rng(0)
    x = rng.random((800, 3))
    y = ((x[:, 0] + 0.3 * np.sin(12 * x[:, 1]) + 0.1 * rng.standard_normal(800)) > 0.6).astype(float)
    model = boosting.fit(x, y, np.array([1, 0, -1]))
    assert ((model.probability(x) > 0.5) == y).mean() > 0.9
    grid = np.linspace(-1, 2, 50)
    for feature, sign in ((0, 1), (2, -1)):
        for row in x[:20]:
            line = np.repeat(row[None], 50, axis=0)
            line[:, feature] = grid
            assert (sign * np.diff(model.margin(line)) >= -1e-12).all()


def naive_margin(model, row):
    total = model.base
    for feature, threshold, value in zip(model.feature, model.threshold, model.value, strict=True):
        at = 0
        while feature[at] >= 0:
            at = 2 * at + 1 + int(row[feature[at]] > threshold[at])
        total += value[at]
    return total


def test_flat_trees_score_as_walked():
    rng = np.random.default_rng(1)
    x = rng.random((200, 4))
    model = boosting.fit(x, (x[:, 0] > x[:, 1]).astype(float), np.zeros(4))
    assert np.allclose(model.margin(x), [naive_margin(model, r) for r in x])


def test_word_hashes(odd_texts):
    found = tokens.batch_words(pa.array(odd_texts))
    want = [(t or "").encode().lower().split() for t in odd_texts]
    assert np.diff(found.offsets).tolist() == [len(w) for w in want]
    flat, seen = [w for ws in want for w in ws], {}
    for word, h in zip(flat, found.hashes.tolist(), strict=True):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)
    sliced = tokens.batch_words(pa.array(odd_texts).slice(8, 5))
    assert sliced.hashes.tolist() == found.hashes[found.offsets[8] : found.offsets[13]].tolist()


def lm_texts():
    rng = random.Random(2)
    a, b = [f"a{i}" for i in range(80)], [f"b{i}" for i in range(80)]
    return [" ".join(rng.choice(a if i % 2 else b) for _ in range(rng.randint(5, 60))) + f" rare{i} rare{i % 50}" for i in range(400)]


def test_language_model(docs_of, odd_docs, no_docs):
    docs = docs_of(lm_texts())
    model, counts = maxent.train(docs.where("doc_id % 7 <> 2"))
    count = Counter()
    for r in docs.collect():
        if r.doc_id % 7 != 2:
            count.update([*r.text.lower().split(), None])
    n, v = sum(count.values()), len(count)
    assert (model.tokens, model.distinct) == (n, v)
    rows = {r.doc_id: r for r in maxent.score_documents(docs, model, counts).collect()}
    for r in docs.collect():
        words = [*r.text.lower().split(), None]
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words)
        assert rows[r.doc_id].base_score == pytest.approx(base) and rows[r.doc_id].n_tokens == len(words)
        assert rows[r.doc_id].n_known == sum(count[w] > 0 for w in words)
    held = [r for i, r in rows.items() if i % 7 == 2]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert maxent.score_documents(odd_docs, model, counts).count() == odd_docs.count()
    assert maxent.score_documents(no_docs, model, counts).count() == 0
    empty, none = maxent.train(no_docs)
    assert maxent.score_documents(docs, empty, none).where("base_score <> 0").count() == 0


def plain_model(texts, rounds):
    """The same model by plain loops over tokens: counts, paths, sums of all rounds, scores."""
    M = maxent
    split = [M.hashed_words(pa.array([t or ""])) for t, _ in texts]
    tokens = [[int(h) for h in hashes] for hashes, _ in split]
    count = Counter(h for words in tokens for h in words)
    cell, mass = {}, Counter()
    for k in range(M.CLASSES):
        mine = sorted((h for h in count if h % M.BRANCH == k), key=lambda h: (-count[h], h))
        total, upto = sum(count[h] for h in mine) + 1, 0
        for h in mine:
            cell[h] = k * M.CELLS + min((2 * upto + count[h]) * M.CELLS // (2 * total), M.CELLS - 1)
            upto += count[h]
            mass[cell[h]] += count[h] + 1
        mass[(k + 1) * M.CELLS - 1] += 1
    tail = lambda h: (h % M.BRANCH + 1) * M.CELLS - 1
    weight = Counter()

    def bias(d, node):
        if d == 0:
            sizes = [sum(mass[c] for c in range(k * M.CELLS, (k + 1) * M.CELLS)) for k in range(M.CLASSES)] + [len(texts) + 0.5]
        else:
            n = M.BRANCH ** (M.DEPTH - d)
            sizes = [sum(mass[c] for c in range((node * M.BRANCH + i) * n, (node * M.BRANCH + i + 1) * n)) for i in range(M.BRANCH)]
        sizes = [max(s, 0.01) for s in sizes]
        return [math.log(s / sum(sizes)) for s in sizes]

    memo = {}

    def path(word, last, before):
        one = lambda x: np.array([x], np.uint64)
        steps = [(0, 0, [int(r[0]) for r in M.root_rows(one(before), one(last))], M.END if word is None else cell.get(word, tail(word)) // M.CELLS)]
        if word is not None:
            c = cell.get(word, tail(word))
            for d in range(1, M.DEPTH + 1):
                node = c // M.BRANCH ** (M.DEPTH - d + 1)
                steps.append((d, node, [int(M._row(3 + d, one(last), np.array([M.FIRST[d] + node]))[0])], c // M.BRANCH ** (M.DEPTH - d) % M.BRANCH))
        for d, node, rows, taken in steps:
            if (d, node) not in memo:
                memo[d, node] = bias(d, node)
            z = [b + sum(weight[r, k] for r in rows) for k, b in enumerate(memo[d, node])]
            norm = math.log(sum(map(math.exp, z)))
            yield rows, [x - norm for x in z], taken

    def walk(words):
        before = last = int(M.BEGIN)
        for word in [*words, None]:
            yield word, last, before
            before, last = last, 0 if word is None else word

    for r in range(rounds):
        sums = Counter()
        for words, (_, turn) in zip(tokens, texts, strict=True):
            for step in walk(words) if turn == r else ():
                for rows, logs, taken in path(*step):
                    for row in rows:
                        for k in range(M.BRANCH):
                            sums[row, k, "e"] += math.exp(logs[k])
                        sums[row, taken, "o"] += 1
        for row, k, side in list(sums):
            if side == "e":
                rate = M.ROOT_RATE if row < M.ROOT_ROWS else M.LOWER_RATE
                weight[row, k] += rate * math.log((sums[row, k, "o"] + M.PRIOR) / (sums[row, k, "e"] + M.PRIOR))

    def score(text):
        total = 0.0
        for step in walk([int(h) for h in M.hashed_words(pa.array([text or ""]))[0]]):
            total += sum(logs[taken] for _, logs, taken in path(*step)) / math.log(10)
            if step[0] is not None:
                total += math.log10((count[step[0]] + 1) / mass[cell.get(step[0], tail(step[0]))])
        return total

    return score


def test_language_model_equals_plain_loops(docs_of):
    docs = docs_of([*lm_texts()[:40], None, "", "one", "one one one"])
    model, counts = maxent.train(docs.where("doc_id <> 3"))
    turns = {r.doc_id: r.t for r in docs.select("doc_id", F.pmod(maxent.row_key(), F.lit(maxent.ROUNDS)).alias("t")).collect()}
    rows = docs.collect()
    plain = plain_model([(r.text, turns[r.doc_id]) for r in rows if r.doc_id != 3], maxent.ROUNDS)
    text = {r.doc_id: r.text for r in rows}
    for r in maxent.score_documents(docs, model, counts).collect():
        assert r.score == pytest.approx(plain(text[r.doc_id]), rel=1e-4), r.doc_id


def test_language_model_sums_to_one(docs_of):
    """All cells and the end sum to one after any context; so do the words of a cell and the unknown one."""
    model, counts = maxent.train(docs_of(lm_texts()))
    cells = np.arange(maxent.CLASSES * maxent.CELLS)
    for before, last in ((maxent.BEGIN, maxent.BEGIN), (model.known[3], model.known[9]), (np.uint64(77), np.uint64(78))):
        at = lambda x, n: np.full(n, x, np.uint64)
        top = np.exp(model.log_odds(np.zeros(1, np.int64), maxent.root_rows(at(before, 1), at(last, 1))).astype(float))[0]
        p = top[cells // maxent.CELLS]
        for d in range(maxent.DEPTH):
            node = maxent.FIRST[d + 1] + cells // maxent.BRANCH ** (maxent.DEPTH - d)
            logs = model.log_odds(node, [maxent._row(4 + d, at(last, len(cells)), node)])
            p = p * np.exp(logs[np.arange(len(cells)), cells // maxent.BRANCH ** (maxent.DEPTH - 1 - d) % maxent.BRANCH])
        assert p.sum() + top[maxent.END] == pytest.approx(1, abs=1e-4)
    words = counts.collect()
    cell = model.look_up(np.array([r.h for r in words], np.int64).view(np.uint64))[0]
    unknown = np.zeros(len(cells))
    unknown[maxent.CELLS - 1 :: maxent.CELLS] = 1
    assert (np.bincount(cell, [r.c + 1 for r in words], len(cells)) + unknown).tolist() == model.mass.tolist()


def test_language_model_whatever_the_partitions(docs_of):
    docs, scores = docs_of(lm_texts()), []
    for n in (1, 8, 32):
        model, counts = maxent.train(docs.where("doc_id % 7 <> 2").repartition(n))
        scores.append([r.score for r in maxent.score_documents(docs, model, counts).orderBy("doc_id").collect()])
    assert scores[1] == pytest.approx(scores[0], rel=1e-6) and scores[2] == pytest.approx(scores[0], rel=1e-6)


def test_rare_words_come_from_the_join(docs_of, monkeypatch):
    """With few known words, and with none as the first level alone has too many, counts and base stay and the cells sum to all counts."""
    docs = docs_of(lm_texts())
    sums = []
    for bound in (1 << 20, 60, 0):
        monkeypatch.setattr(maxent, "KNOWN_WORDS", bound)
        model, counts = maxent.train(docs)
        assert len(model.known) <= bound and model.mass.sum() == model.tokens - model.ends + model.distinct - 1 + maxent.CLASSES
        found = maxent.score_documents(docs, model, counts)
        sums.append(sorted(map(repr, found.select("doc_id", "n_known", F.round("base_score", 6)).collect())))
        assert found.where("score > 0 or score is null").count() == 0
    assert sums[0] == sums[1] == sums[2]

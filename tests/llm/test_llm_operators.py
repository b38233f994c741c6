"""Each operator against brute force on small tables, and on rows with nulls, empty texts and repeated ids."""

import math
import re
import zlib

import duckdb
import numpy as np
import pytest

from divit.llm import queries as Q

ODD = "doc_id long, text string, lang string, source string, n_chars long, extra string"
ROWS = [(1, None, None, None, None, "x"), (2, "", "en", "a", 0, None), (3, "one two three four", "en", "a", 18, "y"), (3, "one two three four", "en", "a", 18, "y"), (None, "lost row", "de", "b", 8, "z"), (5, "w " * 3000, "fr", "b", 6000, None)]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(sf, name):
    return duckdb.sql(f"SELECT * FROM '{sf}/{name}.parquet'").fetchall()


def low(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text)


def components(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_jaccard_join(spark, sf):
    docs = sorted(table(sf, "documents"))
    sets = []
    for d in docs:
        w = WORD.findall(low(d[1] or ""))
        sets.append({tuple(w[i:i + 3]) for i in range(max(len(w) - 2, 1))} if w else set())
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * (x := len(sets[i] & sets[j])) >= 90 * (len(sets[i]) + len(sets[j]) - x)]
    root = components(len(docs), links)
    want = {d[0]: (len(s), docs[r][0]) for d, s, r in zip(docs, sets, root)}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in Q.op1_ngram_jaccard_join(spark, sf).collect()} == want


def test_toxicity_separates_held_out_rows(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    rows = Q.op2_toxicity(spark, sf).collect()
    assert len(rows) == len(table(sf, "documents")) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    label = {r[0]: r[2] for r in table(sf, "labels")}
    held = [(r.score, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    one, zero = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in one for b in zero])
    print("held-out AUC", auc, len(one), len(zero))
    assert auc > 0.8


def test_toxicity_learns_every_word(spark):
    from divit.llm.toxicity import score_toxicity

    many = [f"{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}{chr(97 + i // 676)}" for i in range(300)]
    bad = [(i * 10 + j, f"{w} filler{i * 10 + j}", 1) for i, w in enumerate(many) for j in range(10)]
    good = [(10_000 + i, f"plain clean{i}", 0) for i in range(9000)]
    docs = spark.createDataFrame([r[:2] for r in bad + good], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in bad + good], "doc_id long, toxic int")
    asked = docs.unionByName(spark.createDataFrame([(50_000 + i, f"{w} unseen") for i, w in enumerate(many)], "doc_id long, text string"))
    found = {r.doc_id: r.predicted for r in score_toxicity(asked, labels, examples=20_000).where("doc_id >= 50000").collect()}
    assert len(found) == 300 and all(found.values())


def test_toxicity_neighbours_are_exact():
    from divit.llm.toxicity import BlockMaxIndex

    r = np.random.Generator(np.random.PCG64(3))
    scale = r.uniform(1, 9, 400)
    vectors = [(np.sort(r.choice(400, n, replace=False)), r.integers(1, 5, n).astype(float)) for n in r.integers(1, 60, 500)]
    vectors[7] = vectors[11] = vectors[300]
    index = BlockMaxIndex(vectors, scale, 2.0)
    full = np.zeros((500, 400))
    for i, (w, t) in enumerate(vectors):
        full[i, w] = (1 + np.log(t)) * scale[w]
    unit_ = full / np.linalg.norm(full, axis=1)[:, None]
    for q in (0, 7, 11, 123, 499):
        for without in (-1, q):
            unknown = np.array([1.0, 3.0])
            cos = unit_ @ full[q] / np.sqrt((full[q] ** 2).sum() + (((1 + np.log(unknown)) * 2.0) ** 2).sum())
            want = sorted((-round(float(c), 9), i) for i, c in enumerate(cos) if c > 0 and i != without)[:25]
            assert [(round(s, 7), i) for s, i in index.nearest(*vectors[q], 25, unknown, without)] == [(round(-s, 7), i) for s, i in want]


def test_toxicity_scores_texts_alone(spark):
    from divit.llm.toxicity import score_toxicity

    rows = [(i, f"awful {'nasty' if i % 3 else 'vile'} thing number {i}" if i % 4 == 0 else f"nice calm thing number {i}", i % 4 == 0) for i in range(200)]
    docs = spark.createDataFrame([(d + k * 1000, t) for d, t, _ in rows for k in (0, 1)] + [(None, rows[0][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(d, int(y)) for d, _, y in rows], "doc_id long, toxic int")
    by_text = {}
    for r in docs.join(score_toxicity(docs, labels), "doc_id").collect():
        by_text.setdefault(r.text, set()).add((r.score, r.predicted))
    assert all(len(v) == 1 for v in by_text.values())
    assert all(next(iter(by_text[t]))[1] == int(y) for _, t, y in rows)


def test_packing_round_trip(spark, sf):
    from tokenizers import Tokenizer
    import public_tokenizers as mod

    tok = Tokenizer.from_file(str(mod.path("byte_bpe_50k.json")))
    want = {d[0]: tok.encode(d[1] or "", add_special_tokens=False).ids + [0] for d in table(sf, "documents")}
    rows = Q.op3_packing(spark, sf).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r), by_seq.setdefault(r.sequence_id, []).append(r)
        ids = want[r.doc_id]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes())
    for d, ids in want.items():
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.length > 0
            at += r.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    total = sum(map(len, want.values()))
    assert len(by_seq) <= math.ceil(total / 1024) * 1.05 + 8


def unit(rows):
    ok = {}
    for r in rows:
        v = np.array([np.nan if x is None else x for x in r[1]], float) if r[1] is not None else np.array([np.nan])
        if np.isfinite(v).all() and np.linalg.norm(v) > 0:
            ok[r[0]] = v
    return ok


def test_embedding_near_dedup(spark, sf):
    rows = sorted(table(sf, "embeddings"))
    ok, label = unit(rows), {r[0]: r[2] for r in rows}
    at = {r[0]: i for i, r in enumerate(rows)}
    ids = list(ok)
    m = np.array([ok[i] / np.linalg.norm(ok[i]) for i in ids])
    sim = m @ m.T
    links = [(at[ids[i]], at[ids[j]]) for i in range(len(ids)) for j in range(i) if label[ids[i]] is not None and label[ids[i]] == label[ids[j]] and sim[i, j] >= 0.93]
    n, root = np.bincount(np.array(links, int).ravel(), minlength=len(rows)), components(len(rows), links)
    want = {r[0]: (int(n[i]), rows[root[i]][0]) for i, r in enumerate(rows)}
    assert {r.vec_id: (r.n_links, r.component_id) for r in Q.op4_embedding_near_dedup(spark, sf).collect()} == want


def test_source_mixing(spark, sf):
    rows = Q.op5_source_mixing(spark, sf).collect()
    size = {d[0]: len(WORD.findall(d[1] or "")) for d in table(sf, "documents")}
    assert {r.doc_id: r.size for r in rows} == size
    got = {}
    for r in rows:
        assert r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        got.setdefault(r.source, [0, r.target, r.source_size])[0] += r.taken
    assert math.isclose(sum(t for _, t, _ in got.values()), 1.5 * sum(size.values()), rel_tol=1e-9)
    assert all(t <= 2 * s + 1e-6 for _, t, s in got.values())
    most = max(size.values())
    assert all(abs(x - t) <= most for x, t, _ in got.values())
    assert {(r.doc_id, r.taken) for r in Q.op5_source_mixing(spark, sf).collect()} == {(r.doc_id, r.taken) for r in rows}


def test_license_scan(spark):
    from divit.llm.license_scan import KNOWN, scan_licenses

    mit = "Copyright (c) 2020 Somebody\n" + KNOWN["MIT"].upper().replace(" TO ", "\n  TO ")
    rows = [(1, mit), (2, "A text.\nReleased under the MIT licence!\nMore."), (3, None), (4, ""), (5, "mit")]
    got = {r.doc_id: (r.license_id, r.line_licenses) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", ""), 2: (None, "MIT (notice)"), 3: (None, ""), 4: (None, ""), 5: (None, "")}


def test_license_scan_knows_common_licences(spark):
    from divit.llm.license_scan import _BSD, _NAMES, _UNLICENSE, KNOWN, scan_licenses

    whole = {"MIT": "MIT License\n\nCopyright (c) 2020 A\n\n" + KNOWN["MIT"], "ISC": "ISC License\n" + KNOWN["ISC"], "BSD-2-Clause": _BSD.format("1. ", "2. ", "", "HOLDER"), "BSD-3-Clause": "BSD 3-Clause License\n" + _BSD.format("* ", "* ", "* " + _NAMES.format("holder"), "HOLDER"), "Unlicense": _UNLICENSE}
    lines = {"GPL-2.0 (notice)": "This work is licensed under the GNU General Public License, version 2.", "CC-BY-4.0 (notice)": "Licensed under CC BY 4.0.", "BSD-3-Clause (notice)": "Released under the BSD 3-Clause License.", "AGPL-3.0 (notice)": "SPDX-License-Identifier: AGPL-3.0-or-later"}
    docs = [(i, t) for i, t in enumerate([*whole.values(), *(f"A text.\n{t}\nMore." for t in lines.values())])]
    got = [r.license_id or r.line_licenses for r in scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [*whole, *lines]


def test_url_rules(spark, sf):
    rules = [(v, *r.split("/", 1)) for v, r in Q.RULES]
    for r in Q.op7_url_filter(spark, sf).collect():
        url = {p[0]: p[1] for p in table(sf, "pages")}[r.page_id]
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (low(m[1]), m[2]) if m else ("", "")
        fits = [(len(h) + len(p), v, f"{h}/{p}") for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        assert (r.host, r.path) == (host, path)
        assert r.rule == (max(fits)[2] if fits else None) and r.verdict in ("allow", "block")
        assert not fits or r.verdict == max(fits)[1]


def test_nearest_neighbours(spark, sf):
    ok = unit(table(sf, "embeddings"))
    got, hits, all_ = {}, 0, 0
    for r in Q.op8_nearest_neighbours(spark, sf).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in [i for i in ok if i % 20 == 0]:
        best = sorted(((-float(ok[q] @ v), i) for i, v in ok.items() if i != q))[:20]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 21))
        assert all(math.isclose(s, float(ok[q] @ ok[i]), rel_tol=1e-9, abs_tol=1e-12) for _, i, s in mine)
        hits, all_ = hits + len({i for _, i in best} & {i for _, i, _ in mine}), all_ + 20
    print("recall", hits / all_)
    assert hits / all_ >= 0.9


def test_language_of_pages(spark, sf):
    rows = Q.op9_language_id(spark, sf).collect()
    assert len(rows) == len(table(sf, "pages")) and all(r.probability is None or 0 <= r.probability <= 1 for r in rows)


BASE = {"assign": (r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 12), "access": (r"(AKIA[A-Z0-9]+)", 18), "hex": (r"([0-9a-f]+)", 16)}


def test_secret_scan(spark, sf):
    import hashlib

    want = {}
    for d in table(sf, "documents"):
        spans, n = [], {}
        for at, (kind, (pattern, least)) in enumerate(BASE.items()):
            hits = [(m.start(), at, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, d[1] or "") if len(m[1]) >= least]
            n[kind] = len(hits)
            spans += hits
        want[d[0]] = (*n.values(), hashlib.sha256(",".join(s for _, _, s in sorted(spans)).encode()).hexdigest())
    assert {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in Q.op10_secret_scan(spark, sf).collect()} == want


def test_secret_thresholds_count_distinct_strings(spark):
    import random
    import string

    from divit.llm.secret_scan import candidates, redact, scan_secrets, thresholds

    def cut(rows):
        more = [(1, [(0, 24, "alnum", p, name)]) for p, name in rows]
        return thresholds(spark.createDataFrame(more, "doc long, more array<struct<start:int,end:int,kind:string,p:double,name:bigint>>"), 0.1)["alnum", 4]

    uniform = [((i + 0.5) / 2000, i) for i in range(2000)]
    assert cut(uniform) == cut(uniform + [(0.37, -1)] * 5000) == 0.0
    assert cut([(0.0001, i) for i in range(2000)] + [(0.62, -1)] * 5000) > 0.0
    draw = random.Random(5)
    lone = next(t for _ in range(10_000) if (t := "".join(draw.choices(string.ascii_letters + string.digits, k=24))) and (c := candidates(t, [])) and 0.2 < c[0][3] < 0.45)
    docs = spark.createDataFrame([(1, f"see {lone} here")], "doc_id long, text string")
    assert [s.kind for s in scan_secrets(docs).first().spans] == ["random"] and lone not in redact(docs).first().text


def odd(spark, tmp_path, rows):
    spark.createDataFrame(rows, ODD).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0), (2, 0, 1), (None, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None, 1), (2, [0.0, 0.0], 1), (3, [1.0, 0.0], None), (20, [1.0, 0.1], 1), (40, [1.0, 0.1], 1)] if rows else [], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(1, None, None), (2, "http://X.com/a", ""), (None, "", "<a href='http://b.net/'>")] if rows else [], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", [n for n in Q.QUERIES])
@pytest.mark.parametrize("rows", [ROWS, []], ids=["odd", "empty"])
def test_odd_and_empty_tables(spark, tmp_path, name, rows):
    found = Q.QUERIES[name](spark, odd(spark, tmp_path, rows)).collect()
    per_row = ("op1_", "op2_", "op4_", "op5_", "op6_", "op7_", "op9_", "op10_", "op11_", "op12_")
    if not rows:
        assert not found
    elif name.startswith(per_row):
        assert len(found) == {"op4": 5, "op7": 3, "op9": 3}.get(name.split("_")[0], len(ROWS))


def test_packing_ids_are_those_of_tokenizers():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from divit.llm.packing import _encoder

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode, r = _encoder(None), random.Random(8)
    signs = "ab cdE.,'’\n\t\r\u00a0\u0085\u2003 0123é漢😀ſ{}<|>ا\u0301"
    for text in ["", "a<|endoftext|>b", "<|endoftext|>", "  x  ", "it's 12 O’clock\n\n", "\u00a0 \u00a0x"] + ["".join(r.choices(signs, k=r.randrange(40))) for _ in range(3000)]:
        assert encode(text) == tok.encode(text, add_special_tokens=False).ids, text


def test_propagation_is_personalised_pagerank(spark):
    from divit.llm.url_filter import propagate

    links = [("trust", "a", "b"), ("trust", "b", "c"), ("trust", "c", "a"), ("trust", "b", "d"), ("distrust", "x", "a"), ("distrust", "a", "x")]
    seeds = [("trust", "a", 3.0), ("distrust", "x", 2.0)]
    got = {(r.kind, r.host): r.mass for r in propagate(spark.createDataFrame(links, "kind string, src string, dst string").selectExpr("*", "1.0D as weight"), spark.createDataFrame(seeds, "kind string, host string, seed double"), left=1e-6).collect()}
    mass = {(k, h): 0.15 * s for k, h, s in seeds}
    for _ in range(200):
        new = {(k, h): 0.15 * s for k, h, s in seeds}
        for k, a, b in links:
            n = sum(1 for e in links if e[:2] == (k, a))
            new[k, b] = new.get((k, b), 0.0) + 0.85 * mass.get((k, a), 0.0) / n
        mass = new
    assert got.keys() == mass.keys() and all(abs(got[k] - mass[k]) < 1e-4 for k in mass)


def test_distrust_runs_along_links_of_other_hosts_and_all_ancestors(spark):
    from divit.llm.url_filter import filter_urls

    pages = [(1, "http://bad.net/es/1", ""), (2, "http://bad.net/es/2", ""), (3, "http://friend.org/x", '<a href="//bad.net/es/1">x</a>'), (4, "http://calm.org/x", '<a href="http://fine.com/">x</a>')]
    pages += [(5, "http://good.com/a", ""), (6, "http://a.b.c.d.spam.info/x", '<a href=https://bad.net/y>'), (7, "nothing", None), (8, None, None)]
    pages += [(i, "http://bad.net/es/", "") for i in range(20, 26)]  # enough to outweigh what a page without a rule starts with
    rows = {r.page_id: r for r in filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), Q.RULES).collect()}
    assert [rows[i].verdict for i in (1, 2, 3, 4, 5, 7, 8)] == ["block", "block", "block", "allow", "allow", "allow", "allow"]
    assert rows[3].distrust > 0 and rows[6].distrust > 0 and rows[7].host == "" and rows[8].path == ""


def test_strangers_keep_their_verdict(spark):
    from divit.llm.url_filter import filter_urls

    def verdicts(pages, rules):
        return {r.page_id: r.verdict for r in filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}

    pages = [(i, f"http://spam.co.uk/en/{i}", "") for i in range(10)] + [(50, "http://a.co.uk/", ""), (51, "http://www.spam.co.uk/x", '<a href="http://spam.co.uk:80/en/1">'), (52, "http://c.uk:8080/", '<a href="//SPAM.co.uk/">')]
    got = verdicts(pages, [("block", "spam.co.uk/en/")])
    assert all(got[i] == "block" for i in range(10)) and (got[50], got[51], got[52]) == ("allow", "block", "block")
    pages = [(i, f"http://9.1.2.3/bad{i}", "") for i in range(10)] + [(50, "http://10.1.2.3/x", ""), (51, "http://1.2.3/x", "")]
    assert {verdicts(pages, [("block", "9.1.2.3/bad")])[i] for i in (50, 51)} == {"allow"}
    pages = [(i, f"http://bad.host.io/{i}", "") for i in range(10)] + [(50, "http://host.io/", ""), (51, "http://other.host.io/", "")]
    assert verdicts(pages, [("block", "bad.host.io/")])[51] == "allow"  # neighbours of one real parent


def test_secret_thresholds_have_no_switch(spark):
    """One more string never turns the thresholds over: they move little from 1 to 60 random strings."""
    from divit.llm.secret_scan import BINS, thresholds

    def cut(n):
        more = [(1, [(0, 24, "alnum", (i + 0.5) / n, i)]) for i in range(n)]
        return thresholds(spark.createDataFrame(more, "doc long, more array<struct<start:int,end:int,kind:string,p:double,name:bigint>>"), 0.1)["alnum", 4]

    cuts = [cut(n) for n in (1, 5, 19, 20, 21, 60)]
    assert all(c <= 2 / BINS for c in cuts) and cuts == sorted(cuts, reverse=True)


def test_planted_keys_are_found(spark):
    import random

    from divit.llm.secret_scan import redact, scan_secrets

    r = random.Random(4)
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["".join(r.choices(signs, k=40)) for _ in range(60)]
    natural = ["/" + "/".join(r.choice(["usr", "local", "share", "Docs", "v2", "lib64"]) for _ in range(8)) for _ in range(200)]
    docs = [(i, f"see {k} for more") for i, k in enumerate(keys)] + [(1000 + i, f"path {t} here") for i, t in enumerate(natural)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {x.doc_id: len(x.spans) for x in scan_secrets(df).collect()}
    hit = sum(found[i] > 0 for i in range(60))
    miss = sum(found[1000 + i] > 0 for i in range(200))
    print("planted keys found", hit, "of 60; natural strings taken", miss, "of 200")
    assert hit >= 48 and miss <= 20
    lone = [(i, f"see {k} for more") for i, k in enumerate(keys[:5])]
    assert sum(len(x.spans) for x in scan_secrets(spark.createDataFrame(lone, "doc_id long, text string")).collect()) >= 4
    left = {x.doc_id: x.text for x in redact(df).collect()}
    assert all((keys[i] in left[i]) == (found[i] == 0) for i in range(60))


@pytest.mark.parametrize("one_task", [0, 1000])
def test_components_by_rounds_and_by_one_task(spark, one_task):
    from divit.llm.graph import components as reached

    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 60, (40, 2))] + [(i, i + 1) for i in range(100, 160)] + [(7, 7), (None, 3)]
    links += links[:5]
    got = {r.node: r.root for r in reached(spark.createDataFrame(links, "a long, b long"), one_task).collect()}
    own = [(a, b) for a, b in links if a is not None and a != b]
    root = components(161, own)
    assert got == {n: int(root[n]) for pair in own for n in pair}
    assert reached(spark.createDataFrame([], "a long, b long"), one_task).count() == 0

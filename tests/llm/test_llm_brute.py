"""Operators without SQL, and inner steps, against brute force."""
import collections
import random

import numpy as np
import public_tokenizers
import regex
import tiktoken

from navlens.llm import bpe, decontaminate as D, htmltext as H, jaccard as J, sharding as S, toxicity as X

rnd = random.Random(7)


def test_bpe_equals_tiktoken():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coder, split = bpe.ByteBpe(ranks), regex.compile(public_tokenizers.PATTERN).findall
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", "   ", "a\x1c\x1db", " x 　 y\xa0", "it's we'll I'D", "日本語 123４５ ½", "😀 👨‍👩‍👧", "a" * 5000, "ab" * 3000,
             "\n\n \t x", "<|endoftext|>", "\x00", " " * 4000 + "x",
             "".join(chr(rnd.randint(1, 0xD7FF)) for _ in range(5000)),
             "".join(rnd.choice("thesin") for _ in range(5000)), "".join(rnd.choice("=-_*") for _ in range(2000))]
    for text in texts:
        words = split(text)
        ids = [i for w in coder.encode_words([w.encode() for w in words]) for i in w]
        assert ids == want.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()


def test_bpe_query(spark, sf):
    from navlens.llm.queries import op7_byte_bpe
    import hashlib
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op7_byte_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = want.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_shared_lines_is_a_longest_common_subsequence():
    for _ in range(500):
        a, b = ([rnd.choice("abc") for _ in range(rnd.randint(0, 9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = sorted(H.shared_lines(a, b))
        rest = iter(b)
        assert len(got) == best[-1][-1] and all(a[i] in rest for i in got)


def test_html_lines():
    page = ('<head><title>t</title><script>var x="</p>";</script></head><nav><a>m</a></nav><div class="ad-box"><div>x'
            '</div>y</div><article><header><h1>T</h1></header><p>a&nbsp; &amp;amp;<!-- c --><b>b</b><br>d<p>e<script>1'
            '</script>f</article><div id=comments><p>z</p></div><footer>f')
    assert H.main_text(H.page_lines(page), None) == ("T\na &amp;b d\nef", 0)
    assert H.page_lines("<p>cut off <b") == [("cut off", False)]
    mine, other = "<p>site line<p>my own text, long enough", "<p>site line<p>something else altogether here"
    assert H.main_text(H.page_lines(mine), H.page_lines(other)) == ("my own text, long enough", 1)
    assert H.main_text(H.page_lines(mine), H.page_lines(mine)) == ("site line\nmy own text, long enough", 0)


def test_html_query_equals_regex(spark, sf):
    import html
    import re
    from navlens.llm.queries import op10_html_text
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in op10_html_text(spark, sf).collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", pages[r.page_id], re.S).group(1).replace("<br>", " ")
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip()
                  for b in re.split(r"</?p>|</?h1>", body)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def index(texts):
    tf = {i: collections.Counter(D.text_words(t)) for i, t in texts.items()}
    rows = [(i, t, n / sum(c.values())) for i, c in tf.items() for t, n in c.items()]
    return D.ItemIndex(rows, texts), {i: {t: n / sum(c.values()) for t, n in c.items()} for i, c in tf.items()}


def test_block_max_wand_retrieves_all_and_only():
    vocab = [f"w{i}" for i in range(60)]
    texts = {i: " ".join(rnd.choices(vocab, weights=range(60, 0, -1), k=rnd.randint(3, 20))) for i in range(150)}
    idx, impact = index(texts)
    for _ in range(300):
        query, threshold = set(rnd.choices(vocab, k=rnd.randint(1, 12))), rnd.choice([0.1, 0.3, 0.5])
        want = {i for i, x in impact.items() if sum(x.get(t, 0) for t in query) >= threshold - 1e-9}
        got = idx.retrieve([idx.term_id[t] for t in sorted(query) if t in idx.term_id], threshold)
        assert {idx.ids[i] for i, _ in got} == want


def test_decontamination_verifies_question_and_answer():
    words = [f"v{i}" for i in range(40)]
    item = " ".join(words[:25]) + ". " + " ".join(words[25:]) + "."
    idx, _ = index({7: item, 8: "other words altogether stand here in a row."})
    filler = " ".join(f"x{i}" for i in range(200))
    assert [idx.ids[m[0]] for m in idx.matches(D.text_words(f"{filler} {item} {filler}"), 0.35, 0.8)] == [7]
    assert idx.matches(D.text_words(f"{filler} {' '.join(words[:25])} {filler}"), 0.35, 0.8) == []  # no answer
    assert idx.matches([], 0.35, 0.8) == []


def test_minimax_search_on_blocks_equals_full_list(spark):
    for sizes in ([5], [100, 1, 1, 1], [rnd.randint(16, 5000) for _ in range(1500)] + [400_000]):
        upto = np.cumsum(sizes).tolist()
        groups = spark.createDataFrame(list(zip(sizes, upto)), "group_bytes long, upto long")
        full = S.RunningSums(upto, [1] * len(upto))
        for n in (3, 40):
            capacity = S.smallest_capacity(full, max(sizes), n)
            assert S.minimax_cuts(groups, n, blocks=64) == (capacity, S.cut_points(full, capacity, n))
            edges = [0, *S.cut_points(full, capacity, n), upto[-1]]
            assert max(b - a for a, b in zip(edges, edges[1:])) == capacity


def components(sets):
    part = {i: i for i in sets}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x
    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                part[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def near_copies(n_groups, copies, words=60, edits=4):
    out = []
    for g in range(n_groups):
        base = [f"g{g}w{rnd.randint(0, 9999)}" for _ in range(words)]
        for _ in range(copies):
            ws = list(base)
            for _ in range(rnd.randint(0, edits)):
                ws[rnd.randrange(len(ws))] = f"e{rnd.randint(0, 9)}"
            out.append(" ".join(ws))
    return out


def doc_set(text):
    ws = (text or "").lower().split()
    return {tuple(ws[i:i + 3]) for i in range(len(ws) - 2)} if len(ws) > 2 else {tuple(ws)} if ws else set()


def test_jaccard_components(spark, make_docs):
    texts = near_copies(6, 12) + near_copies(1, 6, words=1900, edits=60) + near_copies(2, 4, words=810, edits=30) + ["a b", "A B", "a", None, "", "", "a b c " * 50, "a b c " * 51]
    want = components({i: doc_set(t) for i, t in enumerate(texts)})
    docs = make_docs(texts)
    sets = {i: doc_set(t) for i, t in enumerate(texts)}
    n_links = {i: sum(1 for j in sets if j != i and sets[i] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]))
               for i in sets}
    expected = {i: (len(doc_set(t)), want[i], n_links[i]) for i, t in enumerate(texts)}
    assert {r.doc_id: tuple(r)[1:] for r in J.link_documents(docs).collect()} == expected
    # cut into cells everywhere, the result is the same
    cut = {"list_rows": 2, "group_shingles": 100, "sample": 1}
    assert {r.doc_id: tuple(r)[1:] for r in J.link_documents(docs, **cut).collect()} == expected
    members, roots, _ = J.set_components(docs, **cut)
    node = {r.doc_id: r.node for r in members.collect()}
    root = {r.node: r.root for r in roots.collect()}
    assert all((root.get(node[i], node[i]) == root.get(node[j], node[j])) == (want[i] == want[j])
               for i in want for j in want if texts[i] and texts[j])
    kept = {r.doc_id for r in J.keep_first(docs.unionByName(docs.where("doc_id < 3"))).collect()}
    assert kept == {i for i in want if want[i] == i}


def test_viterbi_restores_disguised_words(spark, sf):
    channel = X.train_channel(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    for noisy, clean in {"1d10t": "idiot", "i d i o t": "idiot", "idiooot": "idiot", "l0s3r": "loser", "m0r0n": "moron",
                         "tr@sh": "trash", "s.t.u.p.i.d": "stupid", "w0rthl3ss": "worthless", "$cum": "scum"}.items():
        assert X.disguised(f"xx {noisy} yy") == [noisy] and channel.restore(noisy) == clean
    assert X.disguised("plain words, a b and 1234.") == []


def test_toxicity_on_held_out_labels(spark):
    from navlens.llm.queries import op4_toxicity
    got = op4_toxicity(spark, "/root/testdata/sf0.1").join(
        spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in got)
    assert hit / sum(r.toxic for r in got) > 0.8 and hit / sum(r.predicted for r in got) > 0.9


def test_jaccard_rows_without_ids_link(spark, make_docs):
    base = [f"w{k}" for k in range(300)]
    mid, end = base[:], base[:]
    mid[0], end[0], end[1] = "x", "x", "y"
    end[299], end[298], end[297], end[296] = "p", "q", "r", "s"
    far = [w for w in end]
    far[150:158] = [f"z{k}" for k in range(8)]
    docs = make_docs([(1, " ".join(base)), (None, " ".join(mid)), (None, " ".join(mid)), (3, " ".join(far)), (None, "alone here now"),
                      (7, " ".join(end))])
    got = sorted(J.link_documents(docs).collect(), key=str)
    sets = [doc_set(r.text) for r in docs.collect()]
    part = components(dict(enumerate(sets)))
    ids = [r.doc_id for r in docs.collect()]
    want = sorted(((ids[i], len(sets[i]), min((ids[j] for j in part if part[j] == part[i] and ids[j] is not None), default=None),
                    sum(1 for j in part if j != i and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])))
                   for i in part), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert {r.component_id for r in got if r.doc_id in (1, 7)} == {1}


def test_short_lists_are_never_copied():
    """Only sets in lists that are longer than the bound are sent to several cells."""
    import pyarrow as pa

    class Held:
        def __init__(self, value):
            self.value = value
    texts = [[rnd.randint(-2 ** 60, 2 ** 60) for _ in range(30)] for _ in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.list_(pa.int64()))], names=["hashes"])
    counts = Held(np.full(J.BUCKETS, 10 ** 9))  # full buckets, as of a corpus of any size, copy nothing
    plain = [r for b in J._index_rows(counts, None, J.RULE)(iter([batch])) for r in b.to_pylist()]
    assert len({(r["token"], r["node"]) for r in plain}) == len(plain)
    token = plain[0]["token"]
    cut = [r for b in J._index_rows(counts, Held({(token, 0): 5}), J.RULE)(iter([batch])) for r in b.to_pylist()]
    more = [r for r in cut if r["token"] == token]
    assert len(more) == 5 and len(cut) == len(plain) + 4

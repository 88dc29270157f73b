"""Classifiers, the block labeller, chat formatting, exact search and the pipeline."""

import hashlib
import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from genoquery.llm import blocks, chat, quality, topk, toxicity
from genoquery.llm.common import held_out, table


# ---- quality ----------------------------------------------------------------------------------------------------------------------

def test_trees_learn_and_walk(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > -0.2)).astype(float)
    trees = quality.fit(x[:2000], y[:2000], rounds=40, depth=3)
    assert ((trees.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97
    for row in x[:5]:  # the flat arrays walk as nested ifs do
        total = trees.base
        for f, c, k, v in zip(trees.feature, trees.cut, trees.child, trees.value, strict=True):
            node = 0
            while c[node] != np.inf:
                node = k[node] + (row[f[node]] > c[node])
            total += v[node]
        assert trees.raw(row[None])[0] == pytest.approx(total)
    assert quality.fit(x[:0], y[:0]).score(x[:1])[0] == 0.5 and quality.fit(x, np.ones(3000)).score(x[:1])[0] > 0.99


def test_a_tree_is_that_of_a_plain_split_search():
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(200, 3)), 1)
    y = (x[:, 1] + 0.3 * rng.normal(size=200) > 0.4).astype(float)
    ridge, rate = 2.0, 0.15
    tree = quality.fit(x, y, rounds=1, depth=2, rate=rate, ridge=ridge)
    p = np.full(200, y.mean())
    slope, curve = p - y, p * (1 - p)

    def best_split(rows):
        found = (1e-6, None, None)
        for f in range(3):
            for cut in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 65)[1:-1])):
                left, right = rows & (x[:, f] <= cut), rows & (x[:, f] > cut)
                if min(curve[left].sum(), curve[right].sum()) >= 0.75:
                    gain = sum(
                        slope[s].sum() ** 2 / (curve[s].sum() + ridge) for s in (left, right)
                    ) - slope[rows].sum() ** 2 / (curve[rows].sum() + ridge)
                    if gain > found[0] + 1e-12:
                        found = (gain, f, cut)
        return found[1:]

    def walk(node, rows, depth):
        f, cut = best_split(rows) if depth < 2 else (None, None)
        if f is None:
            assert tree.child[0][node] == node and tree.value[0][node] == pytest.approx(
                -rate * slope[rows].sum() / (curve[rows].sum() + ridge)
            )
            return
        assert (tree.feature[0][node], tree.cut[0][node]) == (f, pytest.approx(cut))
        walk(tree.child[0][node], rows & (x[:, f] <= cut), depth + 1)
        walk(tree.child[0][node] + 1, rows & (x[:, f] > cut), depth + 1)

    walk(0, np.ones(200, bool), 0)


def test_every_row_twice_gives_the_same_models(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, known = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    once, twice = (quality.train(df, known, per_class=40) for df in (docs, docs.unionByName(docs)))
    assert len(once.feature) == len(twice.feature) > 0 and all((a == b).all() for a, b in zip(once.value, twice.value, strict=True))
    one, two = (toxicity.train(df, known, per_class=40) for df in (docs, docs.unionByName(docs)))
    assert one.level == two.level and (one.weights == two.weights).all() and one.weights.any()


def accuracy(spark, found, column, sf_dir):
    rows = found.filter("held_out").join(
        table(spark, sf_dir, "labels").select("doc_id", F.col(column).alias("y")), "doc_id"
    ).filter("y is not null").collect()
    return sum(r["predicted"] == r["y"] for r in rows) / len(rows), rows


def test_quality_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    found = quality.op3_quality_trees(spark, sf_dir)
    right, rows = accuracy(spark, found, "quality", sf_dir)
    assert right > 0.97 and found.count() == table(spark, sf_dir, "documents").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)


ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "word " * 200_000), (None, "a text"), (5, "same"), (5, "same"), (6, "\x00 \x85   odd."),
    (7, "!!!"), (8, "漢字" * 50)
]


def odd(spark):
    return spark.createDataFrame([(i, t, "l", 1, 0.5) for i, t in ODD], "doc_id bigint, text string, label string, score int, id double")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_scores_of_odd_rows_and_missing_labels(spark):
    docs = odd(spark)
    for rows in ([], [(1, 1, 1), (2, None, None), (None, 0, 0)], [(i, i % 2, i % 2) for i in range(9)] + [(3, 0, 0)]):
        trees, words = quality.train(docs, labels(spark, rows)), toxicity.train(docs, labels(spark, rows))
        for found in (quality.score(docs, trees), toxicity.score(docs, words)):
            got = found.collect()
            assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.keep_good(
        docs, quality.Trees(5.0)
    ).columns == docs.columns and quality.keep_good(docs, quality.Trees(5.0)).count() == len(ODD)
    assert quality.score(docs.limit(0), quality.Trees()).count() == 0 and toxicity.score(docs.limit(0), words).count() == 0


def repeated(spark):
    """100 documents, the good half's first id held by 300 rows more; labels 0 and 1 by turns."""
    texts = [(i, "calm words of a quiet text. " * 9 if i % 2 == 0 else "$$ || ## BUY!!! vile " * 9) for i in range(100)]
    learnt = spark.createDataFrame([(i,) for i in range(0, 100, 2)], "i bigint").filter(~held_out(F.col("i"))).first()["i"]
    return spark.createDataFrame(
        texts + [(learnt, texts[0][1])] * 300, "doc_id bigint, text string"
    ), labels(spark, [(i, i % 2, i % 2) for i in range(100)])


def test_quality_learns_both_labels_where_an_id_repeats(spark):
    docs, known = repeated(spark)
    trees = quality.train(docs, known, per_class=50)
    assert trees.feature and quality.score(docs.filter("doc_id % 2 = 1"), trees).agg(F.min("score")).first()[0] > 0.5


def test_toxicity_learns_both_labels_where_an_id_repeats(spark):
    docs, known = repeated(spark)
    words = toxicity.train(docs, known, per_class=50)
    assert words.level > -30 and toxicity.score(docs.filter("doc_id % 2 = 1"), words).agg(F.min("score")).first()[0] > 0.5


# ---- toxicity ---------------------------------------------------------------------------------------------------------------------

def test_sentences_are_located_from_document_labels():
    r = random.Random(1)
    bad = ["nastyword", "vileword", "foulness"]
    plain = [f"word{i}" for i in range(400)]

    def text(toxic):
        said = [" ".join(r.choice(plain) for _ in range(8)) for _ in range(r.randrange(3, 20))]
        if toxic:
            k = r.randrange(len(said))
            said[k] += " " + r.choice(bad)
            return ". ".join(said) + ".", k
        return ". ".join(said) + ".", None

    made = [(text(i % 3 == 0), i % 3 == 0) for i in range(1500)]
    model = toxicity.fit([toxicity.sentences(t) for (t, _), _ in made[:1000]], np.array([float(y) for _, y in made[:1000]]))
    right = located = 0
    for (t, k), y in made[1000:]:
        right += (model.score(t) >= 0.5) == y
        if y:
            spans = model.located(t)
            located += [t[s["start"] : s["end"]].strip() for s in spans] == [t.split(". ")[k].rstrip(".")]
    assert right >= 0.99 * 500 and located >= 0.95 * sum(y for _, y in made[1000:])


def test_a_step_goes_along_the_slope_of_the_noisy_or():
    r = random.Random(2)
    words = [f"w{i}" for i in range(12)]
    said = [". ".join(" ".join(r.choice(words) for _ in range(4)) for _ in range(r.randrange(1, 5))) for _ in range(60)]
    y = np.array([float("w3" in t.split(". ")[0]) for t in said])
    bags = [toxicity.sentences(t) for t in said]
    stepped = toxicity.fit(bags, y, rounds=1, batch=100, level=-2.0, least=1, floor=None)
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))

    def loss(weights):
        total = 0.0
        for (own, starts), label, b in zip(bags, y, balance, strict=True):
            p = toxicity.Words(weights, -2.0).sentence_scores(own, starts)
            none = np.prod(1 - p)
            total -= b * np.log(1 - none if label else none)
        return total

    checked = 0
    for code in np.unique(np.concatenate([w for w, _ in bags])):
        slope = []
        for e in (1e-2, -1e-2):
            weights = np.zeros(1 << toxicity.BITS, np.float64)
            weights[code] = e
            slope.append(loss(weights) / e)
        slope = sum(slope) / 2
        if abs(slope) > 1e-2:
            checked += 1
            assert np.sign(stepped.weights[code]) == -np.sign(slope)
    assert checked >= 12


def test_the_sample_is_bounded_in_bytes(spark):
    docs = spark.range(400).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("calm words "), F.col("id").cast("string"), F.when(F.col("id") % 2 == 1, " vile").otherwise("")).alias("text")
    )
    known = spark.range(400).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), (F.col("id") % 2).cast("int").alias("toxic"))
    whole = toxicity.sample_bags(docs, known, "doc_id", "text", "toxic", 1000, 1 << 20).collect()
    part = toxicity.sample_bags(docs, known, "doc_id", "text", "toxic", 1000, 1000).collect()
    size = lambda rows, y: sum(len(r["words"]) + len(r["starts"]) for r in rows if r["label"] == y)
    largest = max(len(r["words"]) + len(r["starts"]) for r in whole)
    assert len(whole) > 250 and all(
        0 < size(part, y) < 1000 + largest for y in (0, 1)
    ) and {tuple(r) for r in part} <= {tuple(r) for r in whole}


def test_noisy_or():
    model = toxicity.Words(np.zeros(1 << toxicity.BITS, np.float32), -2.0)
    p = 1 / (1 + np.exp(2))
    assert model.score("one. two! three") == pytest.approx(1 - (1 - p) ** 3) and model.score("") == 0 and model.score(None) == 0 and model.score("... !!") == 0


def test_toxicity_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    right, rows = accuracy(spark, toxicity.op5_toxic_instances(spark, sf_dir), "toxic", sf_dir)
    hit = sum(r["predicted"] == r["y"] == 1 for r in rows)
    print(right, hit, sum(r["predicted"] for r in rows), sum(r["y"] for r in rows))
    assert right > 0.95 and hit >= 0.6 * sum(r["y"] for r in rows) and hit >= 0.9 * sum(r["predicted"] for r in rows)


# ---- blocks -----------------------------------------------------------------------------------------------------------------------

def texts(page):
    return [b[0] for b in blocks.leaf_blocks(page)]


def test_leaf_blocks():
    assert texts(
        "<p>a<b>b</b> c<br>d<p>e &amp;&lt;&#228;&nbsp;f</p><!-- x --><script>var a='<p>no</p>'</script>g"
    ) == ["ab c d", "e &<ä f", "g"]
    assert texts("<ul><li>a<li>b <a href='x>y'>c</a></ul>d < e <3") == ["a", "b c", "d < e <3"]
    assert texts("<table><tr><td>1<td>2<tr><th>3</table><style>p{}</style><p>") == ["1", "2", "3"]
    assert texts("<p>cut <!-- open") == ["cut"] and texts("<p>cut <script>open") == ["cut"] and texts("") == [] and texts(None) == []
    assert texts("<DIV CLASS=x>Up</DIV><img src='a>b'>per") == ["Up", "per"]
    assert texts("<p>We have <math><mi>x</mi><mo>=</mo><mn>2</mn></math> here</p>") == ["We have x=2 here"]
    deep = blocks.leaf_blocks("<div>" * 5000 + "x")
    assert deep == [("x", (blocks._token("div"),), 0)]
    under = blocks.leaf_blocks(
        "<footer class=footer>" + "".join(f'<div class="a{i} b c d e f g h i j k l m n o">' for i in range(30)) + "x",
        blocks.trained()["seen"]
    )
    assert {blocks._token("footer"), blocks._token(".footer")} <= set(under[0][1])
    assert blocks.leaf_blocks("<p>ab <a>cd</a></p>")[0][2] == 2


def test_gradients(monkeypatch):
    """A step of the fit goes along the loss's slope, as differences of the loss give it."""
    made = [blocks.training_page(i) for i in range(3)]
    pages, ys = [blocks.numbers(b) for b, _ in made], [y for _, y in made]
    model = {k: v.astype(np.float64) for k, v in blocks.initial().items()}
    monkeypatch.setattr(blocks, "initial", lambda: {k: v.copy() for k, v in model.items()})
    steps = blocks.fit(pages, ys, rounds=1, batch=3, rate=1e-3)  # Adam's first step is the sign of the slope, at 0.3 of the rate
    total = sum(map(len, ys))

    def loss(m):
        return sum(-(y * np.log(p) + (1 - y) * np.log(1 - p)).sum() for y, p in zip(ys, blocks.label(m, pages), strict=True)) / total

    rng, checked = np.random.default_rng(3), 0
    for name, weights in model.items():
        for at in rng.integers(0, weights.size, 40):
            slope = []
            for e in (0.02, -0.02):
                moved = weights.copy()
                moved.flat[at] += e
                slope.append(loss(model | {name: moved}) / e)
            slope = sum(slope) / 2
            if abs(slope) > 3e-4:
                checked += 1
                assert np.sign(steps[name].flat[at] - np.float32(weights.flat[at])) == -np.sign(slope), (name, at, slope)
    assert checked > 40


def test_a_fit_lowers_the_loss():
    made = [blocks.training_page(i) for i in range(3)]
    pages, ys = [blocks.numbers(b) for b, _ in made], [y for _, y in made]
    loss = lambda m: np.mean(
        [-(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9)).mean() for y, p in zip(ys, blocks.label(m, pages), strict=True)]
    )
    assert loss(blocks.fit(pages, ys, rounds=30, batch=3)) < 0.2 * loss(blocks.initial())


def test_batches_and_single_pages_agree():
    model = blocks.initial()
    pages = [blocks.numbers(b) for b, _ in map(blocks.training_page, range(6))]
    for one, many in zip((blocks.label(model, [p])[0] for p in pages), blocks.label(model, pages), strict=True):
        assert one == pytest.approx(many, abs=1e-5)
    for page in pages:
        assert blocks.label_long(model, page, chunk=3) == pytest.approx(blocks.label(model, [page])[0], abs=1e-5)
    groups = list(blocks.together([5, 1, 100, 7, 2], 20))
    assert sorted(i for g in groups for i in g) == list(range(5)) and [2] in groups and all(
        len(g) * max([5, 1, 100, 7, 2][i] for i in g) <= 20 for g in groups if g != [2]
    )


def test_a_page_of_100_000_blocks_takes_bounded_memory(labeller):
    import resource

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = blocks.leaf_blocks("<article>" + "<p>One more block of the page.</p>" * 100_000, labeller["seen"])
    assert len(blocks.label_long(labeller, blocks.numbers(found))) == 100_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000  # kilobytes


def test_the_weights_are_those_of_a_fit(labeller):
    made = blocks.train(200)
    assert {k: v.shape for k, v in made.items()} == {k: v.shape for k, v in labeller.items()} and blocks.WEIGHTS.stat().st_size < 1 << 20


@pytest.fixture(scope="module")
def labeller():
    return blocks.trained()


def test_labeller_on_pages_it_has_not_seen(labeller):
    made = [blocks.training_page(10**6 + i, labeller["seen"]) for i in range(200)]
    found = blocks.label(labeller, [blocks.numbers(b) for b, _ in made])
    right = sum(int(((p >= 0.5) == (y > 0.5)).sum()) for p, (_, y) in zip(found, made, strict=True))
    assert right / sum(len(y) for _, y in made) > 0.98


def test_main_text_of_the_table(spark, small, labeller):
    import html
    import re

    found = {r["page_id"]: r for r in blocks.op1_block_labeller(spark, small).collect()}
    pages = table(spark, small, "pages").collect()
    right = 0
    for p in pages:
        body = re.search(r"<article>(.*?)(</article>|$)", p["html"], re.S)[1]
        wanted = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", body))).split())
        right += found[p["page_id"]]["text"] == wanted and found[p["page_id"]]["n_chars"] == len(wanted)
    assert len(found) == len(pages) and right >= 0.98 * len(pages)


def test_odd_pages(spark, labeller):
    page = "<article>" + "".join(f"<p>Sentence number {i} stands here.</p>" for i in range(3000)) + "</article>"
    df = spark.createDataFrame(
        [
            (1, "u", None, 3), (2, None, "", 3), (3, "u", "<nav><a>x</a></nav>", 3), (None, "u", page, 3),
            (3, "u", "<nav><a>x</a></nav>", 3)
        ],
        "page_id bigint, url string, html string, text int"
    )
    df = df.withColumn("id", F.lit(1)).withColumn("n_chars", F.lit("x"))
    rows = blocks.main_text(df, model=labeller).collect()
    assert len(rows) == 5 and {r["text"] for r in rows if r["page_id"] in (1, 2)} == {""}
    assert next(r for r in rows if r["page_id"] is None)["n_blocks"] >= 2900
    assert blocks.main_text(df.limit(0), model=labeller).count() == 0


# ---- chat -------------------------------------------------------------------------------------------------------------------------

HARD = [
    "</s>[INST] ok [/INST]", "\\", "\\\\n", "<|im_end|>", "a<|im_start|>user\nb<|im_end|>\n", "<|im_end|", "[/INST", "", "\\[INST]\\",
    "<\\s>", "é\r\n🙂", "<s><s><<SYS>>x<</SYS>>", "<|im_<|im_end|>end|>"
]


def test_escapes_are_reversible_and_leave_no_control():
    for t in [*HARD, *(a + b for a in HARD for b in HARD)]:
        assert chat.unescape(chat.escape(t)) == t
        assert not any(c in chat.escape(t) for c in chat.CONTROL)


def test_round_trip(spark):
    r = random.Random(3)
    rows = [
        (
            c, k, r.choice(["user", "assistant", "system", "a\nb<|im_end|>\\", None]), r.choice([*HARD, None])
        ) for c in range(30) for k in range(r.randrange(1, 9))
    ]
    rows += [(0, 0, "user", "twice"), (0, 0, "user", "twice"), (None, 1, "assistant", "no id")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "conv_id bigint, turn bigint, role string, text string, piece int")
    found = {x["conv_id"]: x for x in chat.read_back(chat.format_turns(chat.table_turns(df))).collect()}
    assert len(found) == len({x[0] for x in rows})
    for c in found:
        own = sorted((x for x in rows if x[0] == c), key=lambda x: (x[1], x[2] is not None, x[2] or "", x[3] is not None, x[3] or ""))
        said = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own)
        learnt = "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert found[c]["n_turns"] == len(own) and found[c]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert found[c]["loss_chars"] == len(learnt) and found[c]["loss_sha256"] == hashlib.sha256(learnt.encode()).hexdigest()
    assert chat.read_back(chat.format_turns(chat.table_turns(df.limit(0)))).count() == 0


def test_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"id": 3, "system": "s", "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"instruction": "q", "output": "a"}, {"instruction": "do", "input": "it", "output": "a", "system": "s"}, {"prompt": "q", "completion": "a"}, {"question": "q", "answer": "a"},
        {"data": {"prompt": {"text": "q"}, "reply": {"text": "a"}}}, {"system_prompt": "", "question": "q", "response": "a"}, {"what": 1}, [1], "not an object",
    ]
    df = spark.createDataFrame(
        [(i, json.dumps(x) if x != "not an object" else "{") for i, x in enumerate(records)] + [(99, None)], "id bigint, record string"
    )
    found = {}
    for r in sorted(chat.record_turns(df).collect(), key=lambda r: (r["conv_id"], r["turn"] or 0)):
        found.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    qa = [("user", "q"), ("assistant", "a")]
    assert all(found[i] == qa for i in (0, 2, 3, 5, 6, 7, 8))
    assert found[1] == [("system", "s"), *qa] and found[4] == [("system", "s"), ("user", "do\n\nit"), ("assistant", "a")]
    assert all(found[i] == [(None, None)] for i in (9, 10, 11, 99))
    more = [
        json.dumps(
            {
                "messages": [{"role": "user", "content": 3, "at": 1}, {"role": None, "content": "a"}, None], "extra": {"id": 1},
                "question": "x"
            }
        )
    ]
    said = chat.record_turns(spark.createDataFrame([(1, x) for x in more], "id bigint, record string")).orderBy("turn").collect()
    assert [(r["role"], r["text"]) for r in said] == [("user", "3"), ("", "a"), ("", "")]
    assert chat.fingerprint({"b", "a"}) == chat.fingerprint({"a", "b"}) != chat.fingerprint({"a"})
    assert chat.schema_paths(df.selectExpr("array(struct(id, record as r)) as m", "id").schema) == {"m[].id", "m[].r", "id"}
    with pytest.raises(ValueError):
        chat.table_turns(df)


def digests(df):
    return sorted(
        (
            r["conv_id"], r["n_turns"], r["turns_sha256"], r["loss_sha256"]
        ) for r in chat.read_back(chat.format_turns(chat.table_turns(df))).collect()
    )


def test_tables_of_many_layouts_give_the_same_conversations(spark):
    said = [(c, [("user", f"q{c} </s>"), ("assistant", f"a{c}\n[INST]")]) for c in range(5)]
    named = {"user": "human", "assistant": "gpt"}
    rows = [(c, k, role, text, 1.5) for c, turns in said for k, (role, text) in enumerate(turns)]
    share = [(c, k, named[role], text) for c, k, role, text, _ in rows]
    tables = {
        "rows": spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string, piece double"),
        "other rows": spark.createDataFrame(share, "thread bigint, position int, `from` string, value string"),
        "rows of content": spark.createDataFrame(share, "conversation_id bigint, turn int, role string, content string").withColumn("text", F.lit("no")),
        "messages": spark.createDataFrame(said, "id bigint, messages array<struct<role:string,content:string>>").withColumn("note", F.lit(1)),
        "conversations": spark.createDataFrame([(c, [(named[r], t) for r, t in turns], "") for c, turns in said], "id bigint, conversations array<struct<`from`:string,value:string>>, system string"),
        "instructions": spark.createDataFrame([(c, t[0][1], t[1][1], None) for c, t in said], "id bigint, instruction string, output string, input string"),
        "nested": spark.createDataFrame([(c, ((t[0][1],), (t[1][1],))) for c, t in said], "id bigint, data struct<prompt:struct<text:string>,reply:struct<text:string>>"),
    }
    known = chat.registry()
    wanted = digests(tables["rows"])
    assert [x[0] for x in wanted] == list(range(5)) and all(digests(df) == wanted for df in tables.values())
    assert len({chat.select(chat.schema_paths(df.schema), known) for df in tables.values()}) == len(tables)
    system = spark.createDataFrame(
        [(1, [("user", "q"), (None, None)], "s"), (2, None, None)],
        "id bigint, messages array<struct<role:string,content:string>>, system string"
    )
    assert [tuple(r)[2:] for r in chat.table_turns(system).orderBy("turn").collect()] == [("system", "s"), ("user", "q"), ("", "")]


def test_a_long_conversation(spark):
    df = spark.range(30_000).select(
        F.lit(4).alias("conv_id"), "id", F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("t"), "id").alias("text")
    ).withColumnRenamed("id", "turn")
    row = chat.read_back(chat.format_turns(chat.table_turns(df))).collect()[0]
    assert row["n_turns"] == 30_000 and row["loss_sha256"] == hashlib.sha256(
        "".join(f"t{i}" for i in range(1, 30_000, 2)).encode()
    ).hexdigest()


# ---- search -----------------------------------------------------------------------------------------------------------------------

def slow_top(vectors, k=10):
    """(query, rank, id, score) rows, in plain Python; rows are told apart by their place."""
    whole = [
        (i, [int(np.floor(1024 * x)) for x in v]) for i,
        v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    found = []
    for n, (q, own) in enumerate(whole):
        if q is not None and q % 100 == 0:
            scored = sorted(
                (-max(-topk.LIMIT, min(topk.LIMIT, sum(a * b for a, b in zip(own, v, strict=False)))), i is None, i or 0) for m,
                (i, v) in enumerate(whole) if m != n
            )[:k]
            found += [(q, rank + 1, None if none else i, -s) for rank, (s, none, i) in enumerate(scored)]
    return sorted(found, key=str)


def fast_top(df):
    return sorted(((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in topk.top_k(df, F.col("id") % 100 == 0).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_top_k_matches_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(topk, "CELL_VECTORS", 150)
    monkeypatch.setattr(topk, "CELL_QUERIES", 3)
    r = np.random.default_rng(seed)
    rows = [(int(i), [float(np.float32(x)) for x in (r.integers(-2, 3, 8) / 4 if i % 2 else r.normal(size=8) / 4)]) for i in range(700)]
    rows += [
        (700, None), (701, []), (800, [1.0, None]), (900, [float("nan")] * 8), (901, [float("inf")] * 8), (None, [1.0] * 8),
        (1000, [0.5, 0.25])
    ]
    rows += [(100, [9.0] * 8), (100, [9.0] * 8), (1100, [])]  # ids and whole rows that repeat, and an empty query
    df = spark.createDataFrame([(*x, 3) for x in rows], "vec_id bigint, embedding array<double>, rank int")
    assert fast_top(df) == slow_top(rows)
    assert topk.top_k(df.limit(0), F.col("id") % 100 == 0).count() == 0


def test_top_k_over_all_ids_and_one_hot_id(spark, monkeypatch):
    monkeypatch.setattr(topk, "CELL_VECTORS", 64)
    r = np.random.default_rng(7)
    ids = [-(2**63), 2**63 - 1, 10**12, -(10**18), *range(200), *[77] * 100]
    rows = [(i, r.normal(size=4).tolist()) for i in ids]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert fast_top(df) == slow_top(rows)


def test_top_k_of_huge_components(spark):
    rows = [(0, [1e12, -1e12]), (1, [1e12, 1.0]), (2, [1e12, -1e12]), (3, [-1e12, 1e12]), (100, [1e15, 1e15])]
    assert fast_top(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")) == slow_top(rows)


def test_pruning_skips_blocks_but_no_result():
    r = np.random.default_rng(4)
    centres = r.integers(-500, 500, (20, 16))
    vectors = np.concatenate([c + r.integers(-20, 20, (64, 16)) for c in centres])
    ids = np.arange(len(vectors))
    found = topk.search(ids[::64], vectors[::64], ids, ids, vectors, 5, block=64)
    for q in ids[::64]:
        s = vectors @ vectors[q]
        s[q] = -(10**12)
        best = sorted(ids, key=lambda i: (-s[i], i))[:5]
        assert [(q, i, s[i]) for i in best] == [x for x in found if x[0] == q]


# ---- pipeline ---------------------------------------------------------------------------------------------------------------------

def test_pipeline_of_odd_and_of_no_documents(spark, tmp_path):
    """Null texts and ids, an id with two texts, whole rows that repeat and a column of any name pass through every stage."""
    import corpus_pipeline as cp

    sf_dir = "/root/testdata/sf0.001"
    whole = table(spark, sf_dir, "documents")
    some = whole.limit(60)
    null = some.limit(1)
    more = [
        null.withColumn("text", F.lit(None).cast("string")), null.withColumn("doc_id", F.lit(None).cast("bigint")),
        some.limit(1).withColumn("text", F.lit("another text of this id, with words of its own.")), some.limit(5)
    ]
    docs = some
    for df in more:
        docs = docs.unionByName(df)
    for name, start in (
        ("odd", docs.withColumn("__text", F.lit("x")).withColumn("key", F.lit(1))),
        ("none", whole.limit(0).withColumn("__text", F.lit("x")).withColumn("key", F.lit(1)))
    ):
        at = start
        for k, (_, stage) in enumerate(cp.STAGES):
            path = str(tmp_path / f"{name}{k}")
            stage(spark, at, sf_dir).write.parquet(path)
            at = spark.read.parquet(path)
            if k < len(cp.STAGES) - 1:
                assert at.columns == start.columns and at.count() <= start.count()
        assert (at.count() > 0) == (name == "odd")


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp
    from test_duplicates import brute, exact

    sf_dir = "/root/testdata/sf0.01"
    docs = table(spark, sf_dir, "documents")
    bench = [
        set(
            zip(*[(r["text"] or "").lower().split()[k:] for k in range(5)], strict=False)
        ) for r in table(spark, sf_dir, "benchmark").collect()
    ]
    kept = {r["doc_id"]: r for r in docs.collect()}
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        before, docs = kept, spark.read.parquet(str(tmp_path / str(k)))
        if k == len(cp.STAGES) - 1:
            assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} == set(before)
            break
        assert docs.columns == table(spark, sf_dir, "documents").columns
        kept = {r["doc_id"]: r for r in docs.collect()}
        assert set(kept) <= set(before) and len(kept) >= 0.75 * len(before)
        if name == "ngram_jaccard_join":
            wanted = brute([(i, r["text"]) for i, r in before.items()])
            assert set(kept) == {i for i, (c, _) in wanted.items() if c == i}
        if name == "substring_dedup":
            # nothing of 60 words is left twice, and texts without a repeat are as they were
            assert sum(m.any() for m in exact([(i, r["text"]) for i, r in kept.items()], 60).values()) <= 2
            assert all(kept[i]["n_chars"] == len(kept[i]["text"]) for i in kept)
        if name == "benchmark_decontamination":
            for r in kept.values():
                own = set(zip(*[(r["text"] or "").lower().split()[k:] for k in range(5)], strict=False))
                assert not any(len(own & b) > 0.6 * len(b) for b in bench if b)
    assert len(cp.STAGES) == 5 and cp.run(spark, sf_dir).count() == docs.count()


def test_sql_of_the_queries(spark, small):
    import duckdb

    from genoquery.llm import queries

    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        found = con.execute(sql)
        columns = [c[0] for c in found.description]
        assert sorted(map(str, found.fetchall())) == sorted(
            str(tuple(r)) for r in queries.queries()[name](spark, small).select(*columns).collect()
        )

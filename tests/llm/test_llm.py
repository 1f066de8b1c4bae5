"""The training-data operators against brute force, on edge rows and on the tables."""

import hashlib
import math
import random
import re
import tempfile
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from vettica.llm import bytegrams, chat, decontaminate, fertility, jaccard, packing, pii, queries, suffix_tree, template, toxicity, urls, warc
from vettica.llm.common import shared_folder

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, id string, token string, component string"
LONG = "word " * 30_000 + "a" * 60_000


def rows(*texts):
    return [(i, t, "en", "s", len(t or ""), 1.0, "x", "y", "z") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def edges(spark):
    """Nulls, empties, a very long text, ties, repeats, and clashing extra columns."""
    same = "one two three four five six seven eight nine ten eleven twelve"
    found = rows(None, "", "  \n", LONG, same, same, "three short words", "three short words", "x@y.org and 10.0.0.1")
    return spark.createDataFrame([*found, (4, same, None, None, None, None, None, None, None), (None, same, "en", "s", 1, 1.0, "", "", "")], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def collected(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def lower(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in split(text)]


# --- toxicity ---------------------------------------------------------------


def test_toxicity_separates_held_out_texts(spark):
    # about half of the texts labelled toxic here hold no word that the others lack
    folder = "/root/testdata/sf0.1"
    scored = queries.op1_toxicity(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    found = scored.where("held_out").join(labels, "doc_id").select("score", "toxic").collect()
    order = sorted(found, key=lambda r: r.score)
    place = [i for i, r in enumerate(order) if r.toxic == 1]
    ones, zeros = len(place), len(order) - len(place)
    assert (sum(place) - ones * (ones - 1) / 2) / (ones * zeros) > 0.7


def test_insults_are_predicted_and_clean_texts_left_alone(spark):
    folder = "/root/testdata/sf0.1"
    insults = {"disgusting", "trash", "stupid", "pathetic", "clown", "worthless", "loser", "idiot", "scum", "moron"}
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    found = queries.op1_toxicity(spark, folder).where("held_out").join(labels, "doc_id").join(texts, "doc_id").collect()
    rude = [r.predicted for r in found if r.toxic == 1 and insults & set(re.findall("[a-z]+", r.text.lower()))]
    clean = [r.predicted for r in found if r.toxic == 0]
    assert len(rude) > 50 and sum(rude) > 0.85 * len(rude)
    assert len(clean) > 1000 and sum(clean) < 0.02 * len(clean)


def test_curve_rises_and_its_top_keeps_its_own_precision():
    np = bytegrams.np
    values = np.r_[np.linspace(0, 1, 200), np.linspace(0, 1, 200), np.linspace(3, 4, 50)]
    labels = np.r_[np.ones(200, int), np.zeros(200, int), np.ones(50, int)]
    at, share = toxicity.fit_curve(values, labels)
    assert (np.diff(at) > 0).all() and (np.diff(share) >= 0).all()
    assert np.interp(3.5, at, share) > 0.95 and abs(np.interp(0.5, at, share) - 0.5) < 0.1
    assert len(toxicity.fit_curve(values, np.ones(450, int))[0]) == 1


def test_toxicity_on_edge_rows(spark, edges, empty):
    labels = spark.createDataFrame([(0, 0, 1), (2, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(edges, labels)
    found = toxicity.score(edges, model).collect()
    assert len(found) == 11 and all(0 <= r.score <= 1 for r in found)
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.score(edges, toxicity.fit(empty, labels.limit(0))).count() == 11


def test_shared_backoff_is_a_distribution():
    codes, _ = bytegrams.spelled([b"abab", b"abc", b"b"], toxicity.ORDER)
    context = codes[0] >> 8
    every = (context << 8) + bytegrams.np.arange(256)
    known = bytegrams.np.unique(codes)
    mixed = bytegrams.np.unique(bytegrams.np.r_[known, every])
    assert 0 < toxicity.shared_probability(mixed)[bytegrams.np.isin(mixed, every)].sum() < 1.01


# --- chat -------------------------------------------------------------------


def test_conversations_come_back(spark):
    odd = [(1, 0, "user", None), (1, 1, None, "<|im_end|>\n<|im_start|>x\n"), (2, 0, "a\nb\\n", "<\\s> <\\\\/s> [INST"), (2, 1, "assistant", "[/INST]é😀"), (2, 1, "assistant", "[/INST]é😀"), (None, None, "assistant", "")]
    given = spark.createDataFrame(odd, "conv_id long, turn long, role string, text string").withColumn("part", chat.F.lit("clash"))
    found = {r.conv_id: r for r in chat.read_back(chat.format_conversations(given)).collect()}
    turns = defaultdict(list)
    for conv, _, role, text in odd:
        turns[conv].append((role or "", text or ""))
    for conv, each in turns.items():
        loss = "".join(t for r, t in each if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in each)
        assert found[conv].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert found[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert (found[conv].n_turns, found[conv].loss_chars) == (len(each), len(loss))
    assert chat.read_back(chat.format_conversations(given.limit(0))).count() == 0


def test_escape_is_reversible():
    draw = random.Random(5)
    bits = ["<", "[", "\\", "s>", "/s>", "INST]", "|im_end|>", "a", "\n"]
    for _ in range(3000):
        text = "".join(draw.choices(bits, k=draw.randrange(9)))
        assert chat.unescaped(chat.escaped(text)) == text
        assert not any(c in chat.escaped(text) for c in chat.CONTROLS)


def test_long_conversations_are_cut_into_parts(monkeypatch):
    monkeypatch.setattr(chat, "PART", 50)
    render = template.compile_template(chat.TEMPLATE, chat.FILTERS)
    messages = [{"role": "assistant", "text": "t" * 20}] * 9
    parts = list(chat.parts(render(messages=iter(messages)), "<|im_end|>\n"))
    assert len(parts) > 3 and sum(len(list(chat.turns_of(p[0]))) for p in parts) == 9


def test_templates_fold_and_stay_in_their_sandbox():
    folded = template.fold(template.parse("a{{ 'b' ~ 1 }}{% if 1 == 2 %}no{% elif true %}c{% endif %}{{ x }}"), {})
    assert folded == (template.Text("ab1c"), template.Output(template.Name("x")))
    run = template.compile_template("{% for m in ms %}{% if not loop.first and m.a != 'q' %}-{% endif %}{% generation %}{{ m['a'] }}{% endgeneration %}{% endfor %}")
    assert list(run(ms=[{"a": "p"}, {"a": "q"}, {"a": "r"}])) == [("p", True), ("q", True), ("-", False), ("r", True)]
    for bad in ("{{ x.__class__ }}", "{{ x() }}", "{% include 'x' %}", "{% for a %}{% endfor %}", "{% if a %}"):
        with pytest.raises(template.TemplateError):
            list(template.compile_template(bad)(x="text"))


# --- packing ----------------------------------------------------------------


def test_pieces_hold_each_id_once(spark, documents, collected):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    pieces = defaultdict(list)
    found = packing.pack(documents, queries.vocabulary("word_bpe_49k.json")).collect()
    assert len({r.sequence_id for r in found}) == len(found) and {r.offset for r in found} == {0}
    for r in found:
        assert r.length & (r.length - 1) == 0 and r.length <= 4096 and 1 << r.bucket == r.length
        pieces[r.doc_id].append(r)
    for doc, text in collected.items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        each = sorted(pieces[doc], key=lambda r: r.start)
        assert [i for r in each for i in r.ids] == ids and {r.doc_tokens for r in each} == {len(ids)}
        assert all(r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r.ids)) for r in each)


def test_word_ids_are_the_tokenizers():
    words = packing.WordIds(queries.vocabulary("word_bpe_49k.json"))
    for text in ("<|endoftext|>a <|start", "ΟΔΥΣΣΕΥΣ Σ. İstanbul ǅ ß", "é àb ̀", "\x1c\x85\xa0x ½² \x00", "it's I'LL 'S 日本語 <|startoftext|> x", LONG):
        assert list(words.of(text)) == words.tokenizer.encode(text, add_special_tokens=False).ids


def test_word_ids_with_a_small_memory(monkeypatch):
    """Words leave the memory, come back from its old half, or are looked up again."""
    monkeypatch.setattr(packing, "REMEMBERED", 4)
    words = packing.WordIds(queries.vocabulary("word_bpe_49k.json"))
    draw = random.Random(5)
    known = ["The", "caf\u00e9's", "x1y2", "don't", "\u4e2d\u6587", "A.b", "zebra", "stop!!", "ein", "<|x|>", "Ll\u00f3&&&"]
    for _ in range(60):
        text = " ".join(draw.choice(known) for _ in range(draw.randint(0, 7)))
        assert words.of(text).tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


def test_word_memory_is_one_and_bounded(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 200)
    path = queries.vocabulary("word_bpe_49k.json")
    words = packing.WordIds(path)
    rng = random.Random(1)
    spelled = lambda n: "".join(rng.choices("abcdefgh", k=n))
    memory = lambda: [v for v in vars(words).values() if isinstance(v, dict)]
    for text in [" ".join(f"{spelled(9)} {spelled(8)}." for _ in range(20)) for _ in range(60)]:
        assert words.of(text).tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids
        assert sum(map(len, memory())) <= 2 * (200 + 60)
    monkeypatch.setattr(packing, "REMEMBERED_BYTES", 10_000, raising=False)
    for _ in range(40):
        words.of(spelled(1_000))
    assert sum(len(w) + len(ids) for held in memory() for w, ids in held.items()) < 50_000


def test_packing_edge_rows(edges, empty):
    found = packing.pack(edges, queries.vocabulary("word_bpe_49k.json"))
    assert found.where("doc_id = 0").select("length", "doc_tokens").collect() == [(1, 1)]
    assert found.where("doc_id is null").count() > 0
    assert packing.pack(empty, queries.vocabulary("word_bpe_49k.json")).count() == 0


# --- personal data ----------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, piece):
    digits = [int(c) for c in piece if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in piece.split("."))
    if kind == "card":
        doubled = (d if i % 2 == 0 else 2 * d - 9 * (2 * d > 9) for i, d in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def base_spans(text):
    return [(k, m.start(), m.end()) for k in BASE for m in re.finditer(BASE[k], text or "") if passes(k, m[0])]


TRICKY = (
    "a@b.c_d@e.f x@y z@z.1 (1.2.3.4) 1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.255 é😀 a@b.co joe [at] mail [dot] com",
    "4465758382889437 4465758382889437, 4465 7583 8288 9437 +1 (499) 555-6503.. +12 3-4-5 +1 4465758382889437",
    "1.1.1.1 " * 700 + "😀 q@q.q",
)


def test_base_spans_equal_brute_force(spark, documents, collected):
    extra = spark.createDataFrame([(-1 - i, t) for i, t in enumerate((None, "", *TRICKY))], "doc_id long, text string")
    found = {r.doc_id: r for r in pii.find_personal_data(documents.select("doc_id", "text").unionAll(extra)).collect()}
    for doc, text in {**collected, **{-1 - i: t for i, t in enumerate((None, "", *TRICKY))}}.items():
        spans = base_spans(text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert found[doc].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [found[doc][f"n_{k}"] for k in BASE] == [sum(s[0] == k for s in spans) for k in BASE]
        assert set(joined.split(",")) <= set(found[doc].spans.split(","))
    assert "email:81:104" in found[-3].spans.split(",") or "[at]" in TRICKY[0][81:104]


def test_masking_keeps_columns_and_rows(spark, edges, empty):
    masked = pii.mask_personal_data(edges)
    assert masked.columns == edges.columns and masked.count() == edges.count()
    assert [r.text for r in masked.where("doc_id = 8").collect()] == ["[EMAIL] and [IP]"]
    assert masked.where("doc_id = 0 and text is null").count() == 1
    assert pii.mask_personal_data(empty).count() == 0


def test_labelers_that_agree_are_trusted():
    patterns = [("card", (1, 1, 1, 0, 0, 0), 1, 90), ("card", (0, -1, -1, 0, 0, -1), 1, 200), ("card", (0, 1, 1, 0, 0, 0), 1, 5)]
    post = pii.reliabilities(patterns)
    assert post[0] > 0.9 and post[1] < 0.1 and post[2] > 0.5


# --- quality ----------------------------------------------------------------


def test_quality_counts_equal_brute_force(documents, collected):
    found = {r.doc_id: r for r in fertility.judge_quality(documents, queries.vocabulary("piece_bpe_32k.model")).collect()}
    for doc, text in collected.items():
        words = split(text)
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        often = {w for w, n in Counter(windows).items() if n > 1}
        repeat = len({j for i, w in enumerate(windows) if w in often for j in range(i, i + 5)})
        lines = [x for x in text.split("\n") if split(x)]
        r = found[doc]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), repeat)
        assert (r.n_symbols, r.n_dup_lines) == (sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)))
        assert r.base_failed == (len(words) < 10 or 100 * repeat > 20 * len(words)) and not (r.kept and r.base_failed)


def test_fertility_is_that_of_the_whole_text(collected):
    meter = fertility.Meter(queries.vocabulary("piece_bpe_32k.model"))
    for text in list(collected.values())[:40]:
        plain = " ".join(split(text))
        assert meter.of(text).n_tokens == len(meter.pieces.encode(plain))


def test_quality_edge_rows(edges, empty):
    path = queries.vocabulary("piece_bpe_32k.model")
    found = fertility.judge_quality(edges, path)
    assert found.count() == 11 and found.where("doc_id = 0 and n_words = 0 and base_failed and not kept").count() == 1
    kept = fertility.keep_quality(edges, path)
    assert kept.columns == edges.columns and kept.count() == found.where("kept").count()
    assert fertility.judge_quality(empty, path).count() == 0


def test_bands_reject_junk_and_keep_clean_texts(spark):
    folder = "/root/testdata/sf0.1"
    known = spark.read.parquet(f"{folder}/labels.parquet").where("quality is not null").select("doc_id", "quality")
    given = spark.read.parquet(f"{folder}/documents.parquet").join(known, "doc_id").persist()
    unnamed = given.withColumn("lang", chat.F.lit(None).cast("string"))
    for documents, junk, clean in ((given, 0.9, 0.99), (unnamed, 0.75, 0.99)):
        judged = fertility.judge_quality(documents, queries.vocabulary("piece_bpe_32k.model"))
        found = judged.where("not base_failed").join(known, "doc_id").groupBy("quality", "band").agg(chat.F.avg(chat.F.col("kept").cast("int")).alias("kept"), chat.F.count("*").alias("n")).collect()
        assert {r.band for r in found} == ({"en", "de", "fr", "es"} if documents is given else {"latin"})
        for quality in (0, 1):
            rate = sum(r.kept * r.n for r in found if r.quality == quality) / sum(r.n for r in found if r.quality == quality)
            assert rate > clean if quality else rate < 1 - junk
        if documents is given:
            assert all(r.kept < 0.2 for r in found if r.quality == 0)
    given.unpersist()


# --- language model ---------------------------------------------------------


def test_base_scores_equal_brute_force(documents, collected):
    found = {r.doc_id: r for r in suffix_tree.score(documents).collect()}
    tokens = {d: [*lower(t), ""] for d, t in collected.items()}
    counts = Counter(w for d, ws in tokens.items() if zlib.crc32(str(d).encode()) % 10 for w in ws)
    total = sum(counts.values())
    for doc, ws in tokens.items():
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (len(counts) + 1))) for w in ws)
        r = found[doc]
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), total)
        assert r.held_out == (zlib.crc32(str(doc).encode()) % 10 == 0)


def test_tree_is_a_distribution_over_next_bytes():
    words = [b"banana", b"bandana", b"ban", b""] * 5
    np = bytegrams.np
    codes, number = bytegrams.spelled(words, suffix_tree.DEPTH + 1)
    grown, n = [], np.ones(len(codes))
    for k in range(suffix_tree.DEPTH, -1, -1):
        codes, n = bytegrams.summed(codes & np.int64((1 << 8 * (k + 1)) - 1), n)
        grown.append((codes, n))
    tree = suffix_tree.grow(grown[::-1], float(grown[-1][1].sum()))
    # the probabilities of all one-byte continuations of a token's opening add up to 1
    every = [bytes([b]) for b in range(256) if b not in (0x20, 0x0A)]
    first = tree.log10_of([w + b"" for w in every])
    assert 0 < sum(10.0**first) < 1
    assert tree.log10_of([b"banana"])[0] > tree.log10_of([b"nbaaan"])[0]


def test_contexts_attested_by_a_fixed_count_are_kept(spark):
    np = bytegrams.np
    counts = {b"the": 3_000_000_000, b"qzjx": 400, b"qzjw": 3, b"vqzjx": 200, b"": 50, b"zjw": 0}
    codes, number = bytegrams.spelled(list(counts), suffix_tree.DEPTH + 1)
    grown, n = [], np.array(list(counts.values()), float)[number]
    for k in range(suffix_tree.DEPTH, -1, -1):
        codes, n = bytegrams.summed(codes & np.int64((1 << 8 * (k + 1)) - 1), n)
        found, sums = bytegrams.summed(codes >> 8, n)
        often = (n > 0) & ((k == 0) | (sums[np.searchsorted(found, codes >> 8)] >= 5))
        grown.append((codes[often], n[often]))
    tree = suffix_tree.grow(grown[::-1], float(grown[-1][1].sum()))
    words = spark.createDataFrame([(w.decode(), c) for w, c in counts.items()], "word string, c long")
    lp = {r.word: r.lp for r in suffix_tree.log10_of_words(words, suffix_tree.fit(words)).collect()}
    for word, want in zip(counts, tree.log10_of(list(counts)), strict=True):
        assert math.isclose(lp[word.decode()], want, rel_tol=1e-9)
    # 400 and 200 of 1.2e10 symbols: certain after two bytes, although rare
    assert lp["qzjx"] > -12


def brute_token_tree(train, lp, reach):
    """Adds log10 of what retained contexts of whole tokens make of each token."""
    price = 0.5 * math.log(sum(map(len, train)))
    tree, kept = {}, {}

    def chain(before, w, reach):
        total = lp[w]
        for k in range(1, min(reach, len(before)) + 1):
            context = before[-k:]
            if context in kept:
                total += math.log10(kept[context]) + tree.get((context, w), 0.0)
        return total

    for k in range(1, reach + 1):
        seen = defaultdict(Counter)
        for text in train:
            for i in range(k, len(text)):
                seen[text[i - k : i]][text[i]] += 1
        new, tokens = {}, {}
        for context, after in seen.items():
            total = after.total()
            if total < 5:
                continue
            named = {}
            for w, n in after.items():
                q, root, own = 10 ** chain(context, w, k - 1), 10 ** lp[w], (n - 1) / (total + 4)
                least = total if k == 1 else max(n, 5)
                if n > 1 and n * math.log1p((n - 1) / (least + 4) / root) >= price and n * math.log1p(own / q) >= price:
                    named[w] = (n, own, q)
            if not named:
                continue
            back = (total - sum(n - 1 for n, _, _ in named.values()) + 4) / (total + 4)
            gain = sum(n * math.log(own / q + back) - price for n, own, q in named.values()) + (total - sum(n for n, _, _ in named.values())) * math.log(back)
            if gain >= 0:
                new[context] = back
                tokens |= {(context, w): math.log10(1 + own / q / back) for w, (n, own, q) in named.items()}
        kept |= new
        tree |= tokens
    return kept, lambda text: sum(chain(text[:i], w, reach) for i, w in enumerate(text))


def test_contexts_cross_tokens_as_brute_force_says(spark, monkeypatch):
    monkeypatch.setattr(suffix_tree.token_contexts, "HELD", 300)
    monkeypatch.setattr(suffix_tree.token_contexts, "COUNTED", 500)
    rng = random.Random(4)
    words = [*"abcdefgh", "É", "long"]
    after = {(x, y): rng.choice(words) for x in words for y in words}  # decided by two tokens
    texts = {}
    for doc in range(150):
        text = rng.choices(words, k=2)
        while len(text) < 24:
            text.append(after[tuple(text[-2:])] if rng.random() < 0.6 else rng.choice(words))
        texts[doc] = " ".join(text)
    out = (i for i in range(10_000, 20_000) if zlib.crc32(str(i).encode()) % 10 == 0)
    alone = {next(out): w for w in ["", *words]}
    forth, back = next(out), next(out)
    texts |= alone | {forth: "x " + texts[1], back: "x " + " ".join(reversed(texts[1].split()))}
    given = spark.createDataFrame([*texts.items(), (None, None)], "doc_id long, text string").repartition(3)
    root = {r.doc_id: r.score for r in suffix_tree.score(given, reach=0).collect()}
    end = root[next(iter(alone))]
    lp = {w: root[d] - end for d, w in alone.items() if w} | {"": end}
    lp["x"] = root[forth] - root[1]
    tokens = {d: (*lower(t), "") for d, t in texts.items()}
    lp |= {w.lower(): lp[w] for w in words}
    train = [t for d, t in tokens.items() if zlib.crc32(str(d).encode()) % 10] + [("",)]
    for reach in (1, 2, 3):
        kept, want = brute_token_tree(train, lp, reach)
        assert {len(c) for c in kept} >= {2} or reach == 1
        found = {r.doc_id: r.score for r in suffix_tree.score(given, reach=reach).collect()}
        assert len(found) == len(texts) + 1 and found[None] == pytest.approx(end, rel=1e-9)
        for d, text in tokens.items():
            assert found[d] == pytest.approx(want(text), rel=1e-9)
    assert root[forth] == pytest.approx(root[back], rel=1e-9) and found[forth] > found[back] + 1
    unseen = [d for d in range(150) if zlib.crc32(str(d).encode()) % 10 == 0]
    assert sum(found[d] for d in unseen) > sum(root[d] for d in unseen)


def test_scores_do_not_depend_on_how_texts_are_dealt(documents, monkeypatch):
    want = sorted(suffix_tree.score(documents).collect())
    for name, value in (("TOGETHER", 100_000), ("PART", 10_000), ("ANSWERED", 50_000), ("LAID", 30_000), ("HELD", 3_000), ("SPELLED", 9_000), ("CHUNK", 2_000)):
        monkeypatch.setattr(suffix_tree, name, value)
    found = sorted(suffix_tree.score(documents).collect())
    assert len(found) == len(want) > 0
    for x, y in zip(found, want, strict=True):
        assert x[:5] == y[:5] and x[5:] == pytest.approx(y[5:], rel=1e-12)


def test_tokens_are_asked_for_under_contexts_that_may_be_kept():
    np, tc = bytegrams.np, suffix_tree.token_contexts
    column = packing.pa.array(["a b c", None, "b c"])
    hashes, rows = tc.token_hashes(column)
    grams = [tc.grams(hashes, rows, k)[1] for k in (1, 2)]
    # all grams are in the table, of the contexts only "b"
    keys = np.concatenate([*map(tc.joined, grams), tc.joined(grams[0][1:2, :1]) ^ np.uint64(tc._CONTEXT)])
    bits = np.zeros(1 << 14, np.uint64)
    for shift in tc.SHIFTS:
        place = keys >> np.uint64(shift) & np.uint64(64 * len(bits) - 1)
        np.bitwise_or.at(bits, place >> np.uint64(6), np.uint64(1) << (place & np.uint64(63)))
    found = tc.entries(column, bits, 2)
    assert [len(key) for key, _ in found] == [8, 2, 2, 0, 0]
    assert found[2][0].tolist() == tc.joined(grams[0])[[1, 3]].tolist() and found[2][1].tolist() == [0, 2]


def test_queries_of_a_model_leave_no_shuffle_files(spark, documents):
    local = spark.conf.get("spark.local.dir", tempfile.gettempdir())
    files = lambda: set(Path(local).glob("**/blockmgr-*/*/shuffle_*.data"))
    before = files()
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept = spark.conf.get(setting)
    assert suffix_tree.score(documents).columns[0] == "doc_id"
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(setting) == kept


def test_scoring_edge_rows(edges, empty):
    found = suffix_tree.score(edges)
    assert found.count() == 11 and found.where("doc_id = 0 and n_tokens = 1").count() == 1
    assert found.where("doc_id = 4").select("score").distinct().count() == 1
    assert suffix_tree.score(empty).count() == 0


# --- WARC -------------------------------------------------------------------


def test_archives_equal_their_oracle_and_payloads_come_back(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    last = [(9001, "http://a.b/c d", None), (9002, None, "x" * 200), (9003, "u", "x" * 200), (9004, "u", "x" * 99), (9005, "u", "x" * 99), (None, "u", "x" * 200), (9006, "é", "\r\n\r\nWARC/1.1\r\n0\r\n\r\né😀" * 900)]
    given = pages.unionAll(spark.createDataFrame(last, pages.schema))
    found = warc.archive_pages(given, shared_folder(spark), 3_000).collect()
    html = {r.page_id: (r.html or "").encode() for r in given.collect()}
    assert len(found) == given.count()
    for r in found:
        assert (r.payload_bytes, r.payload_digest) == (len(html[r.page_id]), hashlib.sha256(html[r.page_id]).hexdigest())
        assert r.payload == (None if r.record_type == "revisit" else html[r.page_id])
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in found}
    assert kinds[9003] == kinds[None] == ("revisit", 9002) and kinds[9002] == kinds[9005] == ("response", None)


def test_whole_tables_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{FOLDER}/pages.parquet'")
    want = con.execute(queries.OP7_SQL)
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, queries.op7_warc(spark, FOLDER).select(names).collect())) == sorted(want.fetchall())


def test_broken_segments_and_chunks_stop():
    assert warc.unchunked(warc.chunked(b"abc" * 9, 4)) == b"abc" * 9
    for bad in (b"", b"4\r\nab", b"zz\r\n", b"2\r\nabX"):
        with pytest.raises(ValueError):
            warc.unchunked(bad)
    assert warc.reassembled([(1, None, b"a"), (2, 2, b"b")]) == b"ab"
    for bad in ([(1, None, b"a"), (3, 2, b"b")], [(1, None, b"a"), (2, 3, b"b")], [(1, None, b"a"), (2, None, b"b")], [(2, 1, b"b")]):
        with pytest.raises(warc.ArchiveError):
            warc.reassembled(bad)


# --- Jaccard join -----------------------------------------------------------


def brute_groups(texts):
    sets = {}
    for doc, text in texts.items():
        w = lower(text)
        sets[doc] = frozenset(zip(w, w[1:], w[2:], w[3:], strict=False)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    each = sorted(sets)
    for i, a in enumerate(each):
        for b in each[:i]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small and 100 * small >= 85 * large:
                both = len(sets[a] & sets[b])
                if 100 * both >= 85 * (small + large - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_groups_equal_brute_force(spark, documents, collected):
    draw = random.Random(3)
    base = [f"w{draw.randrange(400)}" for _ in range(120)]
    extra = {}
    for k in range(90):  # variants of one text, some near, some far, some with the same prefix
        words = list(base)
        for _ in range(draw.choice((0, 1, 1, 2, 3, 5))):
            words[draw.randrange(len(words))] = f"n{draw.randrange(30)}"
        extra[100_000 + k] = " ".join(words)
    given = documents.select("doc_id", "text").unionAll(spark.createDataFrame(list(extra.items()), "doc_id long, text string"))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.linked_groups(given).collect()}
    assert found == brute_groups({**collected, **extra})


def test_group_edge_rows(edges, empty):
    found = jaccard.linked_groups(edges)
    assert sorted((r.doc_id, r.component_id) for r in found.collect() if r.doc_id in (0, 1, 4, 5, 6, 7)) == [(0, 0), (1, 1), (4, 4), (4, 4), (5, 4), (6, 6), (7, 6)]
    assert [(r.n_shingles, r.component_id) for r in found.where("doc_id is null").collect()] == [(9, None)]
    kept = jaccard.one_of_each(edges)
    assert kept.columns == edges.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [0, 1, 2, 3, 4, 6, 8] and kept.where("doc_id is null").count() == 1
    assert jaccard.linked_groups(empty).count() == 0 and jaccard.one_of_each(empty).count() == 0


# --- decontamination --------------------------------------------------------


def least_edits(item, text):
    before = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        row = [i]
        for j, b in enumerate(text, 1):
            row.append(min(before[j - 1] + (a != b), before[j] + 1, row[-1] + 1))
        before = row
    return min(before)


def test_edited_items_are_found_within_the_budget(spark):
    items = [(r.item_id, decontaminate.normal(r.text)) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    index = decontaminate.index_of(items, decontaminate.ERROR)
    draw = random.Random(1)
    for _ in range(60):
        n = draw.randrange(len(items))
        k = int(index.edits[n])
        letters = list(items[n][1])
        for _ in range(draw.choice((1, k, k + 1, k + 3))):
            at = draw.randrange(len(letters))
            letters[at : at + draw.choice((0, 1))] = draw.choice(("q", "", "zz"))
        text = decontaminate.normal("before " * draw.choice((0, 3)) + "".join(letters) + " after" * draw.choice((0, 3)))
        edits = least_edits(items[n][1], text)
        found = [m for m in decontaminate.search([text, "other"], index)[0] if m[0] == n]
        assert bool(found) == (edits <= k) and (not found or min(m[3] for m in found) == edits)


def test_leaks_of_the_tables(spark, documents, collected):
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    items = {r.item_id: decontaminate.normal(r.text) for r in benchmark.collect()}
    found = decontaminate.find_leaks(documents, benchmark).collect()
    exact = {(d, i) for d, t in collected.items() for i, x in items.items() if x in decontaminate.normal(t)}
    assert exact <= {(r.doc_id, r.item_id) for r in found}
    for r in found:
        piece = decontaminate.normal(collected[r.doc_id][r.start : r.end])
        assert least_edits(items[r.item_id], piece) <= r.edits <= decontaminate.ERROR * len(items[r.item_id])
    kept = {r.doc_id for r in decontaminate.drop_leaks(documents, benchmark).collect()}
    assert kept == set(collected) - {r.doc_id for r in found}


def test_leak_edge_rows(spark, edges, empty):
    benchmark = spark.createDataFrame([(1, None), (2, ""), (3, "Seven  eight NINE ten eleven"), (None, "short"), (3, "Seven  eight NINE ten eleven")], "item_id long, text string")
    found = decontaminate.find_leaks(edges, benchmark)
    assert sorted((r.doc_id, r.item_id) for r in found.where("doc_id is not null").distinct().collect() if r.item_id) == [(4, 3), (5, 3)]
    assert found.where("item_id is null and doc_id in (6, 7)").count() == 2
    assert decontaminate.find_leaks(edges, benchmark.limit(0)).count() == 0 and decontaminate.find_leaks(empty, benchmark).count() == 0


# --- urls -------------------------------------------------------------------


def test_rules_equal_a_plain_search(spark):
    given = ["http://WWW.Example.com/en/x", "https://a.example.com/en/", "http://example.com/fr", "http://x.net/es/1", "http://net/fr/", "http://com", None, "no", "http://xcom/a", "http://a.com:80/b", "ftp://q.org/#/p?x", "http://spam-farm.example.org/en/1", ""]
    pages = spark.createDataFrame([(i, u, "clash", 1) for i, u in enumerate(given)], "page_id long, url string, host string, score int").unionByName(
        spark.read.parquet(f"{FOLDER}/pages.parquet").selectExpr("page_id + 100 as page_id", "url", "'' as host", "0 as score")
    )
    url = {r.page_id: r.url for r in pages.collect()}
    for r in urls.judge_urls(pages).collect():
        m = re.search(r"://([^/?#]*)([^?#]*)", url[r.page_id] or "")
        host, path = (lower(m[1])[0] if m[1] else "", m[2]) if m else ("", "")
        fit = [(len(x), x, a) for a, x in urls.RULES for h, s in [(x.split("/")[0], x[x.index("/") :])] if (host == h or host.endswith("." + h)) and path.startswith(s)]
        assert (r.host, r.path) == (host, path)
        assert (r.rule, r.verdict if fit else None) == ((max(fit)[1], max(fit)[2]) if fit else (None, None))
        assert r.verdict in ("allow", "block")
    assert urls.judge_urls(pages.limit(0)).count() == 0


def test_the_labelled_table_is_learned(spark):
    pages = spark.createDataFrame([(y, u) for u, y in urls.LABELLED], "page_id long, url string")
    found = urls.judge_urls(pages, rules=()).select("page_id", "score").collect()
    assert sum((r.score >= 0.5) == (r.page_id == 1) for r in found) >= 0.95 * len(found)


# --- pipeline ---------------------------------------------------------------


def test_pipeline_stages_take_effect(spark, documents, collected):
    docs = documents
    texts = dict(collected)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        docs = corpus_pipeline.stored(docs)
        assert docs.columns == documents.columns
        now = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality_rules":
            judge = fertility.Judge(queries.vocabulary("piece_bpe_32k.model"), fertility.BANDS)
            lang = {r.doc_id: r.lang for r in documents.collect()}
            assert set(now) == {d for d, t in texts.items() if judge.of(t, lang[d])[3]}
        elif name == "ngram_jaccard_join":
            assert set(now) == {root for _, root in brute_groups(texts).values()}
        elif name == "personal_data":
            assert set(now) == set(texts) and not any(base_spans(t) for t in now.values() if "@" in (t or ""))
        texts = now
    assert corpus_pipeline.run(spark, FOLDER).select("doc_id").distinct().count() == len(texts)

import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex

from tabprobe.llm import language_id, language_model, toxicity
from tabprobe.llm.letters import Words
from tabprobe.llm.language_model import discounts_of


# ---- language identification

@pytest.fixture(scope="module")
def languages(documents):
    rng = random.Random(5)
    of = {"xx": "abcdefg", "yy": "efghijk", "zz": "klmnopä"}
    rows = []
    for i in range(240):
        lang = list(of)[i % 3]
        words = ["".join(rng.choice(of[lang]) for _ in range(rng.randint(1, 9)))
                 for _ in range(rng.randint(1, 40))]
        rows.append((i, " ".join(words), lang, "s"))
    return rows


def test_held_out_accuracy_and_rows_without_letters(documents, languages):
    odd = [(900, None), (901, ""), (902, "123 !? \n"), (903, "日本"), (904, "abc " * 30_000),
           (905, "ABC", None, None), (905, "ABC", None, None), (None, "klmn")]
    docs = documents([*languages, *odd])
    labelled = docs.filter("doc_id % 4 <> 0 and lang is not null")
    rows = language_id.identify(docs, language_id.train(labelled, docs)).collect()
    assert len(rows) == len(languages) + len(odd)
    truth = {i: lang for i, _, lang, _ in languages}
    held_out = [r for r in rows if r.doc_id in truth and r.doc_id % 4 == 0]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held_out) >= 0.95 * len(held_out)
    of = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    assert of[900] == of[901] == of[902] == ("und", 0.0)
    assert of[903] == ("xx", pytest.approx(1 / 3))
    assert of[904][0] == of[905][0] == "xx" and of[None][0] == "zz"
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.doc_id == 905 for r in rows) == 2


def test_backoff_follows_its_definition(documents, languages):
    docs = documents(languages)
    model = language_id.train(docs.filter("doc_id < 60"), docs, longest=3, most_entries=150)
    table = {n: {int(k): v for k, v in zip(keys, logs)} for n, (keys, logs) in model.tables.items()}
    texts = [t for _, t, _, _ in languages[60:80]] + ["abc Klm9abc-ö", "", "x" * 500]

    def key(text):
        w = Words([text])
        return int(w.hashes(np.array([0]), np.array([len(text)]))[0])

    for text, got in zip(texts, model.scores(texts)[0]):
        total = np.zeros(3)
        for word in regex.findall(r"\p{L}+", text.lower()):
            if key(word) in table[0]:
                total += table[0][key(word)]
                continue
            for i in range(len(word)):
                for n in (3, 2, 1):
                    gram = word[i:i + n]
                    if len(gram) == n and key(gram) in table[n]:
                        total += table[n][key(gram)] / len(word)
                        break
        odds = np.exp(total - total.max())
        assert np.allclose(got, odds / odds.sum())


def test_short_words_and_labels_without_letters(documents):
    rows = [(1, "guten Morgen zusammen", "de"), (2, "ok no", "en"), (3, "12345 !?", "xx"),
            (4, "guten ok"), (5, "no"), (6, "Morgens")]
    docs = documents(rows)
    model = language_id.train(docs.filter("lang is not null"), docs)
    assert model.langs == ["de", "en"]
    of = {r.doc_id: r.lang_pred for r in language_id.identify(docs, model).collect()}
    assert of[1] == of[6] == "de" and of[2] == of[5] == "en" and of[3] == "und"
    only = docs.filter("doc_id = 3")
    assert language_id.train(only, only) is None


def test_a_rare_language_is_learned_beside_a_frequent_one(documents):
    rng = random.Random(8)

    def text(letters):
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7)))
                        for _ in range(12))

    rows = [(i, text("abcdefgh"), "often") for i in range(3_000)]
    rows += [(i, text("mnopqrst"), "seldom") for i in range(3_000, 3_006)]
    rows += [(i, text("mnopqrst")) for i in range(4_000, 4_020)]
    docs = documents(rows)
    model = language_id.train(docs.filter("lang is not null"), docs, most_docs=200,
                              most_entries=3_000)
    found = language_id.identify(docs.filter("doc_id >= 4000"), model).collect()
    assert {r.lang_pred for r in found} == {"seldom"}


def test_counts_of_the_language_model(documents, languages):
    rows = languages[:60]
    docs = documents([*rows, (500, "same same", "xx"), (501, "same same", "xx"), (502, None, "yy")])
    model = language_id.train(docs.filter("lang is not null"), docs, longest=2)
    counts = {n: defaultdict(Counter) for n in range(3)}
    for _, text, lang, *_ in [*rows, (0, "same same", "xx"), (0, "same same", "xx")]:
        for word in regex.findall(r"\p{L}+", text.lower()):
            counts[0][word][lang] += 1
            for n in (1, 2):
                for i in range(len(word) - n + 1):
                    counts[n][word[i:i + n]][lang] += 1
    for n, (keys, logs) in model.tables.items():
        total = Counter()
        for of in counts[n].values():
            total.update(of)
        least = language_id.SMOOTHING / max(total.values())
        assert len(keys) == len(counts[n])
        for gram, of in counts[n].items():
            hashed = Words([gram]).hashes(np.array([0]), np.array([len(gram)]))[0]
            place = int(np.searchsorted(keys, hashed))
            assert keys[place] == hashed
            for k, lang in enumerate(model.langs):
                share = (of[lang] / total[lang] + least) / (1 + least * len(keys))
                assert logs[place, k] == pytest.approx(math.log(share), abs=1e-12)


def test_no_labels(documents, languages):
    docs = documents(languages)
    assert language_id.train(docs.filter("false"), docs) is None
    assert {r.lang_pred for r in language_id.identify(docs, None).collect()} == {"und"}
    assert language_id.identify(documents([]), None).count() == 0


# ---- toxicity

INSULTS = ["idiot", "moron", "stupid", "pathetic"]


@pytest.fixture(scope="module")
def insulted(documents):
    rng = random.Random(6)
    words = ["".join(rng.choice("aeiourstnlmdp") for _ in range(rng.randint(2, 7)))
             for _ in range(300)]
    rows = []
    for i in range(400):
        own = [rng.choice(words) for _ in range(rng.randint(8, 40))]
        if i % 5 == 0:
            own[rng.randrange(8)] = INSULTS[i // 5 % 4]
            own[rng.randrange(8)] = INSULTS[i // 25 % 4]
        rows.append((i, " ".join(own)))
    return rows


@pytest.fixture(scope="module")
def judge(spark, documents, insulted):
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in insulted],
                                   "doc_id long, toxic int")
    return toxicity.train(labels, documents(insulted))


def test_toxic_texts_are_found_and_clean_ones_left(documents, insulted, judge):
    rows = toxicity.score(documents(insulted), judge).collect()
    assert sum(r.predicted == int(r.doc_id % 5 == 0) for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


@pytest.mark.parametrize("word,span", [
    ("idiot", "1d1ot"), ("idiot", "i d i o t"), ("moron", "m.o.r.o.n"), ("stupid", "stuuuupid"),
    ("stupid", "$tup1d"), ("pathetic", "p@th3tic"), ("moron", "M-O-R-0-N"),
])
def test_disguises_are_read(documents, judge, word, span):
    text = f"torn aside {span} rastin moulder"
    assert toxicity.disguised([text.lower()])[0]
    restored = toxicity.Restorer(judge.characters)([text])[0]
    assert word in restored.split(), restored
    clean, toxic = toxicity.score(
        documents([(1, "torn aside rastin moulder"), (2, f"{text} {text}")], 1).orderBy("doc_id"),
        judge).collect()
    assert toxic.score > clean.score


@pytest.mark.parametrize("word,span", [
    ("idiot", "id-iot"), ("stupid", "stu.pid"), ("pathetic", "pa-the-tic"), ("moron", "morron"),
    ("stupid", "stuupid"), ("idiot", "1d107"), ("idiot", "idi07,"), ("idiot", "idi07!"),
    ("idiot", "i d i o t!"), ("moron", "mo ron"), ("pathetic", "pat het ic"),
])
def test_slight_disguises_are_read(documents, judge, word, span):
    text = f"torn aside {span} rastin moulder"
    assert word in toxicity.Restorer(judge.characters)([text])[0].split()
    clean, toxic = toxicity.score(
        documents([(1, "torn aside rastin moulder"), (2, text)], 1).orderBy("doc_id"),
        judge).collect()
    assert toxic.score > clean.score


def test_short_spaced_words_end_in_punctuation_or_not():
    for text in ("you s c u m!", "you s, c, u, m.", "you s c u m", "s c u m! you"):
        assert any("".join(x.strip(",").split()).replace(",", "") == "scum"
                   for x in toxicity.disguised([text])[0])
    assert toxicity.disguised(["plain words, no more.", "", "12,5 99 $"]) == [[], [], []]


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_toxicity_is_learned_from_few_labels(spark, sf_dir, size):
    from tabprobe.llm.queries import op3_toxicity

    folder = os.path.join(os.path.dirname(sf_dir.rstrip("/")), size)
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in op3_toxicity(spark, folder).collect()
            if r.held_out and truth.get(r.doc_id) is not None]
    toxic = [r for r in rows if truth[r.doc_id]]
    assert 2 * sum(r.predicted for r in toxic) > len(toxic)
    assert sum(r.predicted > truth[r.doc_id] for r in rows) <= 0.05 * len(rows)


def test_rare_insults_are_learned(spark, documents):
    rng = random.Random(8)
    words = ["".join(rng.choice("aeiourstnlmdp") for _ in range(rng.randint(2, 7)))
             for _ in range(2000)]
    rare = ["wretch", "bozzler", "jerkwit", "hagfish", "vilekin", "gitface"]
    rows = []
    for i in range(900):
        own = [rng.choice(words) for _ in range(rng.randint(8, 40))]
        if i % 3 == 0:
            own[3] = rare[i // 3 % 50 % 6] if i // 3 % 50 < 6 else INSULTS[i % 4]
        rows.append((i, " ".join(own)))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows],
                                   "doc_id long, toxic int")
    model = toxicity.train(labels, documents(rows))
    texts = [(i, f"torn aside {word} rastin moulder") for i, word in enumerate(rare)]
    assert all(r.predicted for r in toxicity.score(documents(texts), model).collect())


def test_odd_texts_get_the_lowest_score(documents, judge):
    rows = toxicity.score(documents([(1, None), (2, ""), (3, "9" * 10_000), (4, "$$$ ### 🙂"),
                                     (5, "a" * 50_000), (None, "tor"), (5, "")]), judge).collect()
    assert len(rows) == 7 and {r.score for r in rows} == {judge.without}
    assert toxicity.score(documents([]), judge).count() == 0


def test_labels_of_one_class_give_no_model(spark, documents, insulted):
    labels = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    assert toxicity.train(labels, documents(insulted)) is None
    assert toxicity.score(documents(insulted[:3]), None).filter("score = 0").count() == 3


def test_viterbi_finds_the_best_of_all_readings(judge):
    model = judge.characters

    def readings(span, i=0, before="", run=0):
        if i == len(span):
            yield "", 0.0
            return
        c = span[i]
        run = run + 1 if c == before else 1
        letters, cost, skip = c, 0.0, None
        if c in toxicity.LEET:
            letters, cost, skip = toxicity.LEET[c], toxicity.AS_LETTER, toxicity.NO_LETTER
        elif c in toxicity.SEPARATORS:
            letters, skip = "", toxicity.NO_SEPARATOR
        if run > 1 and letters:
            skip = toxicity.REPEATED if run == 2 else toxicity.REPEATED_AGAIN
        for rest, score in readings(span, i + 1, c, run):
            for x in letters:
                yield x + rest, score + cost
            if skip is not None:
                yield rest, score + skip

    def whole(word, score):
        ids = [0, 0, *(model.index[x] for x in word), 0]
        return score + sum(model.logs[a, b, c] for a, b, c in zip(ids, ids[1:], ids[2:]))

    for span in ("1d10t", "st.u.p1d", "moooron", "m 0 r o n"):
        best = min(((-round(whole(w, s), 9), w) for w, s in readings(span)))
        assert model.decode(span) == best[1]


# ---- language model

def plain_model(texts):
    """The same model with dictionaries; gives log10 probabilities of a text's tokens."""
    tokens = [[*(t or "").encode().lower().split(), "END"] for t in texts]
    count = Counter(w for t in tokens for w in t)
    pairs = Counter(p for t in tokens for p in zip(["BEGIN", *t], t))
    endings = Counter(w for _, w in pairs)
    follow = defaultdict(list)
    for (h, _), n in pairs.items():
        follow[h].append(n)

    def steps(values):
        n = Counter(values)
        return discounts_of(np.array([n[1], n[2], n[3], n[4]]))

    def minus(n, d):
        return max(n - (0.0, *d)[min(n, 3)], 0)

    def rest(values, d):
        return sum(d[min(n, 3) - 1] for n in values)

    d1, d2 = steps(endings.values()), steps(pairs.values())
    v = len(count) + 1

    def chance(h, w):
        low = 1 / v
        if pairs:
            low = (minus(endings[w], d1) + rest(endings.values(), d1) / v) / len(pairs)
        if not follow[h]:
            return low
        return (minus(pairs[(h, w)], d2) + rest(follow[h], d2) * low) / sum(follow[h])

    return count, chance


@pytest.mark.parametrize("shards", [1, 5])
def test_scores_of_the_language_model(documents, prose, shards):
    rows = [r for r in prose if r[0] != 109]
    train = [t for i, t in rows if i is not None and i % 5]
    docs = documents(rows)
    model = language_model.train(docs.filter("doc_id % 5 <> 0"), shards)
    got = defaultdict(list)
    for r in language_model.scored(docs, model).collect():
        got[r.doc_id].append(r)
    count, chance = plain_model(train)
    total, v = sum(count.values()), len(count)
    for i, t in rows:
        tokens = [*(t or "").encode().lower().split(), "END"]
        base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (v + 1))) for w in tokens)
        own = sum(math.log10(chance(h, w)) for h, w in zip(["BEGIN", *tokens], tokens))
        assert any(
            (r.n_tokens, r.n_known, r.train_tokens)
            == (len(tokens), sum(count[w] > 0 for w in tokens), total)
            and math.isclose(r.base_score, base, rel_tol=1e-9)
            and math.isclose(r.score, own, rel_tol=1e-9) for r in got[i])
    for h in ["BEGIN", *random.Random(1).sample(sorted(w for w in count if w != "END"), 10)]:
        whole = sum(chance(h, w) for w in [*count, "never seen"])
        assert math.isclose(whole, 1, rel_tol=1e-9)


@pytest.mark.parametrize("shards", [1, 5])
def test_scores_of_order_three(documents, prose, shards):
    """The same model with dictionaries: bigrams count by the words before them."""
    rows = [r for r in prose if r[0] != 109] + [(200 + i, "the cat sat " * 40) for i in range(20)]
    rows += [(301 + 5 * i, f"qq ww x{i // 2} qq ww y{i // 3} qq ww z{i}") for i in range(60)]
    train = [t for i, t in rows if i is not None and i % 5]
    docs = documents(rows)
    model = language_model.train(docs.filter("doc_id % 5 <> 0"), shards, order=3)
    got = defaultdict(list)
    for r in language_model.scored(docs, model).collect():
        got[r.doc_id].append(r.score)

    def tokens_of(text):
        return ["BEGIN", *(text or "").encode().lower().split(), "END"]

    raw, triples = Counter(), Counter()
    for t in map(tokens_of, train):
        raw.update(zip(t, t[1:]))
        triples.update(zip(t, t[1:], t[2:]))
    pairs = Counter(x[1:] for x in triples)
    pairs.update({p: n for p, n in raw.items() if p[0] == "BEGIN"})
    endings = Counter(w for _, w in raw)
    levels = []
    for table in (Counter({(w,): n for w, n in endings.items()}), pairs, triples):
        of, heads = Counter(table.values()), defaultdict(list)
        for key, n in table.items():
            heads[key[:-1]].append(n)
        levels.append((table, heads, discounts_of(np.array([of[k] for k in (1, 2, 3, 4)]))))

    def chance(context, w):
        low = 1 / (len(endings) + 1)
        for k, (table, heads, d) in enumerate(levels):
            if k > len(context):
                break
            own = context[len(context) - k:]
            if heads[own]:
                n = table[(*own, w)]
                low = (max(n - (0.0, *d)[min(n, 3)], 0)
                       + sum(d[min(x, 3) - 1] for x in heads[own]) * low) / sum(heads[own])
        return low

    for i, t in rows:
        own = tokens_of(t)
        want = sum(math.log10(chance(tuple(own[max(0, j - 2):j]), own[j]))
                   for j in range(1, len(own)))
        assert any(math.isclose(x, want, rel_tol=1e-9) for x in got[i])
    for context in [("BEGIN",), (b"the", b"cat"), *random.Random(2).sample(sorted(
            x[:2] for x in triples if "BEGIN" not in x and "END" not in x), 5)]:
        assert math.isclose(sum(chance(context, w) for w in [*endings, "never"]), 1, rel_tol=1e-9)


def test_continuations_are_looked_up_not_unfolded(documents):
    """What scoring a text reads of a context does not grow with its continuations."""
    docs = documents([(1 + 5 * i, f"aa bb c{i}") for i in range(3_000)])
    model = language_model.train(docs, 4, order=3)
    scorer = language_model.Scorer(model)
    asked = []

    class Watched:
        def __init__(self, part):
            self.part = part

        def __getitem__(self, at):
            asked.append(np.size(at))
            return self.part[at]

    scorer.followers.codes = [Watched(p) for p in scorer.followers.codes]
    scorer.trigrams.counts = [Watched(p) for p in scorer.trigrams.counts]
    from tabprobe.llm.language_model import tokens_of
    batch = documents([(1, "aa bb c7 aa bb")]).toArrow().to_batches()[0]
    for _, _, tokens, n in tokens_of(batch):
        scorer.log10(tokens, n)
    assert 0 < sum(asked) <= 2 * 6


def test_a_worker_holds_the_files_of_one_run():
    from tabprobe.llm import token_counts

    before = dict(token_counts._held)
    for run in range(3):
        for kind in ("words", "pairs", "scorer"):
            assert token_counts.held(kind, f"folder{run}", lambda: [run]) == [run]
            assert token_counts.held(kind, f"folder{run}", lambda: ["other"]) == [run]
    assert len(set(token_counts._held) - set(before)) <= 3


def test_frequent_pairs_are_counted_beyond_a_byte(documents):
    rows = [(i, "the cat " * 40) for i in range(20)]
    model = language_model.train(documents(rows), 3)
    count, chance = plain_model([t for _, t in rows])
    want = sum(math.log10(chance(h, w)) for h, w in (("BEGIN", b"the"), (b"the", b"cat"),
                                                     (b"cat", "END")))
    got = language_model.scored(documents([(1, "The CAT")]), model).first()
    assert math.isclose(got.score, want, rel_tol=1e-9)


def test_nothing_to_learn_from(documents):
    model = language_model.train(documents([]))
    got = {r.doc_id: r for r in language_model.scored(
        documents([(1, "a b"), (2, None)]), model).collect()}
    assert got[1].score == 0 and got[1].n_known == 0 and got[1].n_tokens == 3
    assert got[2].n_tokens == 1 and got[2].train_tokens == 0
    assert language_model.scored(documents([]), model).count() == 0


def test_held_out_texts_of_the_given_table(spark, sf_dir):
    from tabprobe.llm.queries import op3_toxicity, op1_language_id, op9_language_model

    rows = op9_language_model(spark, sf_dir).collect()
    gain = sum(r.score - r.base_score for r in rows if r.held_out)
    assert gain > 0
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = [r for r in op1_language_id(spark, sf_dir).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in found) >= 0.95 * len(found)
    assert op3_toxicity(spark, sf_dir).count() == len(truth)


def test_words_are_hashed_in_small_parts(monkeypatch):
    import pyarrow as pa

    from tabprobe.llm import language_model as M

    texts = ["one two  Three", "", None, "x" * 300, "a b", " c\td "] * 40
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    whole = list(M.tokens_of(batch))
    seen, plain = [], M.word_hashes

    def watched(data, offsets):
        seen.append(len(data))
        return plain(data, offsets)

    monkeypatch.setattr(M, "word_hashes", watched)
    monkeypatch.setattr(M, "HASHED_BYTES", 64)
    parts = list(M.tokens_of(batch))
    assert max(seen) == 300 and len(seen) > 40
    assert len(parts) == len(whole) == 1
    for a, b in zip(parts[0], whole[0]):
        assert np.array_equal(a, b)


def test_shards_of_trigrams_grow_with_the_corpus(spark, monkeypatch):
    from tabprobe.llm import language_model as M

    docs = spark.createDataFrame(
        [(i, " ".join(f"w{(i * 7 + j * j) % 40}" for j in range(30))) for i in range(60)],
        "doc_id long, text string")
    few = M.train(docs, shards=2, order=3)
    monkeypatch.setattr(M, "MERGED_TOKENS", 200)
    many = M.train(docs, shards=2, order=3)
    assert len(few.trigrams) == 2 and len(many.trigrams) >= 8
    assert sum(few.trigrams) == sum(many.trigrams) and few.discounts == many.discounts
    assert max(many.trigrams) < max(few.trigrams) / 2
    one, other = ({r.doc_id: r.score for r in M.scored(docs, m).collect()} for m in (few, many))
    assert one == other


def test_trigrams_take_few_bytes(spark, tmp_path):
    from tabprobe.llm import language_model as M

    rng = np.random.default_rng(3)
    keys = np.unique((rng.integers(7_000, 9_000, 20_000).astype(np.uint64) << np.uint64(32))
                     | rng.integers(0, 3_000, 20_000).astype(np.uint64))
    M.write_keys(f"{tmp_path}/0", keys)
    short = M.ShortKeys(f"{tmp_path}/0")
    assert short.rows.itemsize == 3  # 11 bits of contexts, 12 of words
    at, known = short.find(keys)
    assert known.all() and (at == np.arange(len(keys))).all()
    other = np.unique(np.r_[keys - np.uint64(1), keys + np.uint64(1), keys[:9] >> np.uint64(32),
                            keys[:9] + (np.uint64(1) << np.uint64(50)), keys[:9] | np.uint64(1 << 30),
                            keys[:9] << np.uint64(8), np.uint64(0), ~np.uint64(0)])
    at, known = short.find(other)
    assert (known == np.isin(other, keys)).all() and (keys[at[known]] == other[known]).all()
    for some in (keys, keys[:1], keys[:0], np.array([0, ~np.uint64(0)], np.uint64)):
        assert (M.unpacked_keys(M.packed_keys(some)) == some).all()
    docs = spark.createDataFrame(
        [(i, " ".join(f"w{(i * 7 + j * j * i) % 977}" for j in range(300))) for i in range(60)],
        "doc_id long, text string")
    model = M.train(docs, shards=2, order=3)
    files = [f"{model.folder}/trigrams/{s}.npy" for s in range(2)]
    assert sum(np.load(f).nbytes for f in files) <= 5 * sum(model.trigrams)


def test_every_label_is_learned_from(spark, documents):
    """A word that only the labelled texts last by hash have, behind 4 300 other toxic ones."""
    from pyspark.sql import functions as F

    rng = random.Random(9)
    words = ["".join(rng.choice("aeiourstnlmdp") for _ in range(rng.randint(3, 7)))
             for _ in range(2000)]
    last = [r.id for r in spark.range(0, 4_400).orderBy(F.xxhash64(F.lit(3), "id").desc())
            .limit(60).collect()]
    rows = [(i, " ".join([*(rng.choice(words) for _ in range(10)),
                          *(["vilekin" if i in last else "idiot"] if i < 4_400 else [])]))
            for i in range(5_600)]
    labels = spark.createDataFrame([(i, int(i < 4_400)) for i, _ in rows],
                                   "doc_id long, toxic int")
    model = toxicity.train(labels, documents(rows))
    assert model.characters.words.total > 0.97 * sum(len(t.split()) for _, t in rows)
    got = {r.doc_id: r.predicted for r in toxicity.score(
        documents([(1, "torn vilekin moulder"), (2, "torn aside moulder")]), model).collect()}
    assert got == {1: 1, 2: 0}


def test_near_copies_are_told_in_rounds(spark):
    from itertools import combinations

    rng = np.random.default_rng(4)
    rows = [(int(i), *map(int, rng.integers(0, 6, 6))) for i in rng.permutation(150)]
    rows += [(500 + i, *(i + j for j in range(6))) for i in range(6)] + rows[:5]
    names = [f"h{j}" for j in range(6)]
    seen, want = set(), set()
    for doc_id, *own in sorted(rows):
        keys = set(combinations(enumerate(own), 3))
        if seen.isdisjoint(keys):
            want.add(doc_id)
            seen |= keys
    table = spark.createDataFrame(rows, ["doc_id", *names])
    got = [r.doc_id for r in toxicity.unlike(table).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert toxicity.unlike(table.limit(0)).count() == 0


def test_scoring_sorts_no_contexts_again(documents, prose, monkeypatch):
    """Contexts of a batch are its words and pairs, which are sorted once."""
    model = language_model.train(documents(prose), 3, order=3)
    scorer = language_model.Scorer(model)
    tokens, n = next(iter((t, k) for _, _, t, k in language_model.tokens_of(
        pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["a b a b a", "c"]}))))
    sorts, unique = [], np.unique

    def counted(*args, **more):
        sorts.append(len(args[0]))
        return unique(*args, **more)

    monkeypatch.setattr(np, "unique", counted)
    scorer.log10(tokens, n)
    assert len(sorts) == 4  # hashes, words, pairs and triples


def test_equal_words_are_searched_once(judge, monkeypatch):
    asked, counts = [], toxicity.Vocabulary.counts
    monkeypatch.setattr(toxicity.Vocabulary, "counts",
                        lambda self, hashes: asked.append(len(hashes)) or counts(self, hashes))
    text = "plain words that come again " * 400
    assert toxicity.Restorer(judge.characters)([text, text]) == [text, text]
    assert sum(asked) < 2_000  # of 4 000 words and some 12 000 neighbours of them


def test_evidence_is_that_of_the_different_words(judge):
    texts = ["", None, "Torn m-o-r-o-n torn MORON aside", "aside st upid torntorn $tup1d!! été ab",
             "12 $$$", "p a t h e t i c pathetically pathetic Moronic"]
    restore = toxicity.Restorer(judge.characters)
    seen = [regex.findall(r"\p{L}+", t) for t in restore(texts)]
    keys = {}
    for word in {w for words in seen for w in words}:
        hashed = Words([word])
        spans = [(0, len(word))] + [(n, n) for n in toxicity.PREFIXES if len(word) >= n]
        keys[word] = {int(hashed.hashes(np.array([0]), np.array([end]))[0]) ^ mark
                      for mark, end in spans}
    known = np.array(sorted(set().union(*keys.values()))[::2], np.uint64)
    model = toxicity.ToxicityModel(judge.characters, known, np.arange(1.0, len(known) + 1))
    weight = dict(zip(known.tolist(), model.weights.tolist()))
    evidence, n = model.evidence(restore.words(texts))
    assert n.tolist() == [len(words) for words in seen]
    assert evidence.tolist() == [
        sum(weight.get(k, 0) for k in set().union(*(keys[w] for w in words))) for words in seen]


@pytest.mark.parametrize("words", [0, 1, 30_000])
def test_the_filter_loses_no_word(spark, words):
    rng = np.random.default_rng(5)
    keys = rng.integers(-2**63, 2**63, words)
    rows = spark.createDataFrame([(int(k), i + 1) for i, k in enumerate(keys)], "word long, n long")
    known = toxicity.vocabulary(rows)
    assert known.perhaps(keys.view(np.uint64)).all()
    assert known.counts(keys.view(np.uint64)).tolist() == list(range(1, words + 1))
    others = rng.integers(-2**63, 2**63, 10_000).view(np.uint64)
    assert known.perhaps(others).mean() < 0.2

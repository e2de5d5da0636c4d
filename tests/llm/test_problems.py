"""Small cases of every problem: exact results, brute force, round trips, nulls, empty tables, clashing columns."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillmesh.llm import clusters, cooccurrence, encoding, languages, leakage, neardup, personal, residue, splitting
from quillmesh.llm._text import words
from quillmesh.session import cut

DOC = "doc_id long, title string, body string, text string, lang string, source string, labels array<string>, key long, n int, t string"


def docs(spark, rows):
    """rows: (doc_id, body) or dicts; extra columns carry names that operators use inside."""
    out = []
    for r in rows:
        r = r if isinstance(r, dict) else {"doc_id": r[0], "body": r[1]}
        body = r.get("body")
        out.append((r["doc_id"], r.get("title"), body, r.get("text", body), r.get("lang"), r.get("source"), r.get("labels"), 1, 1, "t"))
    return spark.createDataFrame(out, DOC)


# Problem 1


@pytest.mark.parametrize("text", ["a" * 5000, "word " * 2000, "Line one.\r\n\r\n" * 400, "# H\n" + "x y. " * 900, "é" * 1501, "\n" * 4000])
def test_pieces_make_up_the_text_within_the_limit(text):
    spans = splitting.pieces(text, 1500, 150)
    assert all(b - a <= 1500 for a, b, _ in spans)
    assert "".join(text[a + o : b] for a, b, o in spans) == text
    assert all(o == min(150, a + o) for a, b, o in spans[1:]) and len(spans) > 1


def test_cuts_fall_on_blank_lines():
    text = "\n\n".join(["A sentence that goes on for some words."] * 60)
    assert all(text[:b].endswith("\n\n") for a, b, o in splitting.pieces(text, 1500, 100)[:-1])


def test_split_documents_null_empty_and_short(spark):
    got = splitting.split_documents(docs(spark, [(1, None), (2, ""), (3, "short"), (4, "x" * 1500), (5, "y" * 1501)])).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.piece)
    assert {k: len(v) for k, v in by.items()} == {2: 1, 3: 1, 4: 1, 5: 2} and by[2] == [""]
    assert splitting.split_documents(docs(spark, [])).count() == 0


# Problem 2

SAMPLES = {
    "en": ["the cat sat on the mat and it was a very good day for all of us", "we will go to the shop with her because there is no bread in the house"],
    "de": ["die katze sitzt auf der matte und es war ein guter tag für uns alle", "wir gehen mit ihr in den laden weil es im haus kein brot mehr gibt"],
    "fr": ["le chat est assis sur le tapis et ce fut une bonne journée pour nous tous", "nous irons avec elle au magasin parce que il n'y a plus de pain dans la maison"],
}


def test_passages_in_several_languages_and_in_none(spark):
    model = languages.train([(k, s) for k, v in SAMPLES.items() for s in v * 40])
    rows = [
        {"doc_id": 1, "body": SAMPLES["en"][0] + ".\n" + SAMPLES["de"][1] + ".", "lang": "en-GB"},
        {"doc_id": 2, "body": "asdf jkl qwer asdf jkl qwer asdf. blah blah blah blah blah blah blah", "lang": None},
        {"doc_id": 3, "body": None, "title": "", "lang": "und"},
        {"doc_id": 4, "body": SAMPLES["fr"][0], "lang": "FRA"},
        {"doc_id": 5, "body": "```\n" + SAMPLES["fr"][0] + "\n```", "lang": "mul"},
        {"doc_id": 6, "body": SAMPLES["fr"][1], "lang": "mul"},
    ]
    d = docs(spark, rows)
    assert sorted(map(tuple, languages.unlabelled_languages(d, model).collect())) == [(1, "de"), (6, "fr")]
    whole = {r.doc_id: r for r in languages.document_languages(d, model).collect()}
    assert whole[4].lang == "fr" and whole[4].confidence > 0.7 and whole[1].n_languages == 2 and whole[3].lang is None
    assert languages.unlabelled_languages(docs(spark, []), model).count() == 0
    assert languages.document_passages(docs(spark, [])).count() == 0


def test_the_regression_decides_the_language():
    """A word that only one language's training has turns a passage, whose other words all languages share."""
    base = "alpha beta gamma delta epsilon zeta"
    made = [(k, f"{base} {k}word {k}word {k}word") for k in ("en", "de", "fr") for _ in range(60)]
    model = languages.train(made)
    tag = languages.Tagger(model)
    assert [tag.tag([f"{base} {k}word {k}word {k}word"])[0][0][3] for k in ("en", "de", "fr")] == ["en", "de", "fr"]
    flat = languages.Model(0 * model.weights, model.temperature)
    assert languages.Tagger(flat).tag([made[0][1]])[0][0][3:] == (None, 0.0)


def test_a_task_meets_more_words_than_its_table_had_rows():
    """The table grows in the call that needs it, and again, and all words keep their scores."""
    tag = languages.Tagger(languages.train([(k, s) for k, v in SAMPLES.items() for s in v * 40]))
    known = tag.tag([SAMPLES["fr"][0]])
    made = ["".join(p) for p in itertools.islice(itertools.product("abcdefghij", repeat=6), 150_000)]
    for lo in (0, 60_000, 120_000):
        got = tag.tag([" ".join(made[i : i + 10]) for i in range(lo, lo + 30_000, 10)])
        assert len(got) == 3000 and all(len(x) == 1 for x in got)
    assert len(tag.tag([" ".join(made)])[0]) == 1 and len(tag.index) > 150_000
    assert tag.tag([SAMPLES["fr"][0]]) == known and known[0][0][3] == "fr"


def test_texts_are_scored_alike_in_blocks(monkeypatch):
    model = languages.train([(k, s) for k, v in SAMPLES.items() for s in v * 40])
    texts = [SAMPLES["en"][0] + ".\n" + SAMPLES["de"][1] + ".", None, "", SAMPLES["fr"][0]] * 3
    whole = languages.Tagger(model).tag(texts)
    monkeypatch.setattr(languages, "BLOCK", 1)
    assert languages.Tagger(model).tag(texts) == whole and [len(x) for x in whole] == [2, 0, 0, 1] * 3


def test_training_sample_of_long_documents_is_bounded(spark):
    long = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4000)), lambda x: F.concat(F.lit("the cat sat on the mat and it was a good day for number "), x.cast("string"))), "\n").alias("body"))
    samples, code = languages.labelled_passages(long.withColumn("title", F.lit("")))
    size = sum(len(t) for _, t in samples)
    assert 1_500_000 < size < 2_500_000 and not code  # of 9.5 million characters
    short = docs(spark, [{"doc_id": i, "body": f"{SAMPLES[k][0]}.\n{SAMPLES[k][1]}\n```\nx = {i}\n\n```", "lang": k} for i, k in ((1, "en"), (2, "de"), (None, "fr"), (None, "en"))])
    samples, code = languages.labelled_passages(short)
    assert sorted(samples) == sorted((k, s + "." * (i == 0)) for k in ("en", "de", "fr", "en") for i, s in enumerate(SAMPLES[k])) and len(code) >= 4


def test_long_runs_beside_an_address_take_time_in_proportion():
    import time

    began = time.thread_time()
    assert languages.letters("write to a.b@c.example and www.x.example " + "ab" * 100_000 + " or http://x y") == ["write", "to", "and", "ab" * 100_000, "or", "y"]
    assert time.thread_time() - began < 5


def test_labels(spark):
    df = spark.createDataFrame([(x,) for x in ("EN", "en_US", "ger", "fre", "und", "english", "", None, "es-ES", "nl")], "lang string")
    assert [r[0] for r in df.select(languages.label_language(F.col("lang"))).collect()] == ["en", "en", "de", "fr", None, None, None, None, "es", None]


# Problem 3


@pytest.mark.parametrize("shift", [0, 2**40, -(10**6)])
def test_pairs_against_brute_force(spark, shift, monkeypatch):
    monkeypatch.setattr(cooccurrence, "BLOCK", 7)
    rng = random.Random(4)
    rows = [(rng.randrange(30), shift + rng.randrange(12)) for _ in range(300)] + [(1, shift + i) for i in range(25)] + [(None, shift), (2, None)]
    got = {(r.tag_id_a, r.tag_id_b): (r.n_ab, r.n_a, r.n_b, r.n) for r in cooccurrence.item_pairs(spark.createDataFrame(rows, "doc_id long, tag_id long")).collect()}
    have = {(d, t) for d, t in rows if d is not None and t is not None}
    of = {t: {d for d, x in have if x == t} for _, t in have}
    n = len({d for d, _ in have})
    want = {(a, b): (len(of[a] & of[b]), len(of[a]), len(of[b]), n) for a, b in itertools.combinations(sorted(of), 2) if of[a] & of[b]}
    assert got == want


def test_pairs_of_nothing(spark):
    assert cooccurrence.item_pairs(spark.createDataFrame([], "doc_id long, tag_id long")).count() == 0


# Problem 4 and 6


def edited(rng, w, share):
    return [rng.choice("abcdefgh") * 6 + str(rng.randrange(99)) if rng.random() < share else x for x in w]


def corpus(seed, n=60, size=70):
    rng = random.Random(seed)
    vocabulary = [f"vocab{i:04d}" for i in range(900)]
    rows, i = [], 0
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for share in (0, 0, 0.02, 0.06, 0.12)[: rng.randrange(1, 6)]:
            rows.append((i, " ".join(edited(rng, base, share))))
            i += 1
    return [*rows, (i, None), (i + 1, ""), (i + 2, "few words only"), (i + 3, "same word " * 50), (i + 4, "same word " * 60)]


def jaccard(x, y):
    return len(x & y) / len(x | y) if x | y else 0


@pytest.mark.parametrize("block", [2, 5, 8192])
def test_near_duplicates_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr("quillmesh.llm._pairs.BLOCK", block)
    rows = corpus(1)
    sets = {d: set(zip(w, w[1:], w[2:])) for d, t in rows if len(w := words(t)) >= 40}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if jaccard(sets[a], sets[b]) >= 0.6}
    assert {tuple(r) for r in neardup.similar_pairs(docs(spark, rows)).collect()} == want and len(want) > 50


def test_near_duplicate_groups_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(neardup, "COPIES", 3)
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, text) for i in range(6)] + [(10, text + " and more"), (11, None)]
    got = {tuple(r) for r in neardup.similar_pairs(docs(spark, rows)).collect()}
    assert got == {(0, i) for i in range(1, 6)} | {(0, 10)}
    groups = {r.doc_id: (r.group_id, r.copies) for r in neardup.near_duplicate_groups(docs(spark, rows)).collect()}
    assert groups == {**{i: (0, 6) for i in range(6)}, 10: (0, 1)}


def test_no_rows_no_pairs(spark):
    assert neardup.similar_pairs(docs(spark, [])).count() == 0
    assert clusters.cluster_pairs(docs(spark, [(1, None), (2, "")])).count() == 0


def test_clusters_against_brute_force(spark):
    rows = corpus(2, n=40, size=60)
    sets = {d: s for d, t in rows if len(s := {w for w in words(t) if len(w) >= 5}) >= 25}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if jaccard(sets[a], sets[b]) >= 0.5:
            root[find(b)] = find(a)
    groups = {}
    for d in sets:
        groups.setdefault(find(d), []).append(d)
    want = {p for g in groups.values() if len(g) >= 3 for p in itertools.combinations(sorted(g), 2)}
    assert {tuple(r) for r in clusters.cluster_pairs(docs(spark, rows)).collect()} == want and want
    for r in clusters.cluster_summaries(docs(spark, rows)).collect():
        assert r["size"] >= 3 and len(r.typical) == 3


def test_links_of_a_vocabulary_that_is_common_to_all(spark):
    rng = random.Random(8)
    vocabulary = [f"vocab{i:04d}" for i in range(90)]
    rows = [(i, " ".join(rng.sample(vocabulary, 54))) for i in range(120)]
    sets = {d: set(t.split()) for d, t in rows}
    want = {(a, b) for a, b in itertools.combinations(sets, 2) if jaccard(sets[a], sets[b]) >= 0.5}
    fine = cut(neardup.fingerprints(docs(spark, rows), "body", 1, 1, 25, 5))
    key = {r.doc_id: r.key for r in fine.select("doc_id", "key").collect()}
    got = {tuple(sorted((r.a, r.b))) for r in clusters.links(fine, (1, 2)).collect()}
    assert got == {tuple(sorted((key[a], key[b]))) for a, b in want} and len(want) > 50


# Problem 5

GIVEN = ["Helen", "Joaquín", "Стоян"]
FAMILY = [p + s for p in ("Bram", "Cald", "Quill", "Harrow") for s in ("bury", "shaw", "grave", "wick")] + ["Riozabal", "Белелярски"]


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("Write to helen.x@example.org, thanks", ["email"]),
        ("mail me: ann (at) home.test or bob at post dot example dot net", ["email"]),
        ("icon@2x.png and @someone", []),
        ("Call +1 (202) 555-0166 or ０２０ ７９４６ ０９６３", ["phone"]),
        ("Phone 2025550166, Telefon: 03023125686; the order 20255501667 was called", ["phone"]),
        ("my passport no. is AB123456", ["id_number"]),
        ("0049/30/23125686 und (0221) 4710 987", ["phone"]),
        ("EUR 1.266,32 ISBN 978-0-1482-9579-2 SN 86490/626-03 14.05.2024 10:33 Ref 2023-0077-12 #9301-8507 v10.8.89.5 192.0.2.174", []),
        ("My social security number QQ 52 87 26 C goes here", ["id_number"]),
        ("Моето ЕГН е 3215382798 и се пише", ["id_number"]),
        ("Meine Steuernummer lautet 01 473 937 174", ["id_number"]),
        ("They moved to 132 Zelfen Lane, Pel last spring", ["address"]),
        ("Das Paket geht an Dalstr. 177 und ул. Мартар № 23", ["address"]),
        ("Viven en calle Elquogar 107, 1º C, Lan", ["address"]),
        ("met HELEN CALDSHAW; then Bramwick, Helen; Mrs Quillbury; J. Harrowgrave", ["name"]),
        ("con Joaquín Riozabal", ["name"]),
        ("Harrowdale is a place, bramble a plant", []),
        ("", []),
    ],
)
def test_personal_data(text, kinds):
    finder = personal.Finder(GIVEN, FAMILY)
    masked, found = finder.mask(text)
    assert found == kinds, masked
    assert finder.mask(masked)[1] == []


@pytest.mark.parametrize(
    ("text", "masked"),
    [
        ("Часът е при Стоян Чернорашки на втория етаж", "Часът е при [NAME] на втория етаж"),
        ("avec HELEN CHARDEFAILLE au sujet", "avec [NAME] au sujet"),
        ("Ask Helen B. Beaulanque or Durmeret, Joaquín today", "Ask [NAME] or [NAME] today"),
        ("M. Beauponette, Mrs Helen Durmeret and г-н Чернорашки", "[NAME], [NAME] and [NAME]"),
        ("Helen went home. Yes, señor. Somebody saw Helen", "Helen went home. Yes, señor. Somebody saw Helen"),
        ("the 5 m cable, Helena Street, sir", "the 5 m cable, Helena Street, sir"),
    ],
)
def test_given_names_and_forms_of_address_are_anchors(text, masked):
    assert personal.Finder(GIVEN, FAMILY).mask(text)[0] == masked


def test_masking_keeps_the_rest(spark):
    names = spark.createDataFrame([(g, "given") for g in GIVEN] + [(f, "family") for f in FAMILY] + [(None, "given")], "name string, kind string")
    rows = docs(spark, [(1, "Spoke with Helen Caldwick, call 202.555.0107!"), (2, None), (3, ""), (None, "nothing")])
    got = {r.doc_id: (r.masked, r.kinds) for r in personal.mask_personal(rows, names, "body", ("doc_id",)).collect()}
    assert got == {1: ("Spoke with [NAME], call [PHONE]!", ["name", "phone"]), 2: (None, []), 3: ("", []), None: ("nothing", [])}
    assert personal.mask_personal(docs(spark, []), names.limit(0), "body", ("doc_id",)).count() == 0


# Problem 8


def test_ids_equal_the_public_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    try:
        with open(f"{encoding.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    except OSError:
        pytest.skip("no vocabulary here")
    ref = tiktoken.Encoding("own", pat_str=encoding.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = [None, "", " ", "Hello world's  x\n\n", "<|endoftext|>", "a" * 4000, "ab" * 900, "ЖжЯ й", "😀👍🏽" * 300, "".join(rng.choice("abcdef") for _ in range(5000)), " " * 2000 + "x"]
    got = {r.doc_id: list(r.ids) for r in encoding.encode_documents(docs(spark, list(enumerate(texts)))).collect()}
    assert got == {i: ref.encode_ordinary(t or "") for i, t in enumerate(texts)}


# Problem 9


def test_leaks_against_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 60)))) for i in range(12)] + [(99, None), (98, "")]
    rows = [(1000, None), (1001, "")]
    for i in range(60):
        w = [rng.choice(vocabulary) for _ in range(80)]
        if i % 3 == 0:
            src = items[rng.randrange(12)][1].split()
            n = rng.randrange(8, 20)
            at = rng.randrange(max(1, len(src) - n))
            w[30:30] = src[at : at + n]
        rows.append((i, "  ".join(w).upper() if i % 2 else ", ".join(w)))
    runs = lambda t: {tuple(w[i : i + 13]) for w in [words(t)] for i in range(len(w) - 12)}
    want = {(d, i) for d, t in rows for i, x in items if runs(t) & runs(x)}
    found = leakage.leaked_items(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and want
    assert all(0 < r.containment <= 1 for r in found)
    assert leakage.leaked_items(docs(spark, rows), spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert leakage.leaked_items(docs(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0


# Problem 10


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("<h1>404 Not Found.</h1>\nnginx", ["error"]),
        ("** Zugriff verweigert. Sie haben keine Berechtigung, diesen Inhalt zu öffnen. **", ["error"]),
        ("PLEASE TURN ON JAVASCRIPT AND COOKIES IN YOUR BROWSER TO CONTINUE READING.", ["notice"]),
        ("Моля, включете JavaScript в браузъра си, за да видите тази страница.", ["notice"]),
        ("Dear {{ first_name }}, your order", ["field"]),
        ("We meet [INSERT DATE HERE] at %LOCATION% with @@name@@", ["field"]),
        ("text text text text text text", ["filler"]),
        ("Lorem ipsum dolor sit amet, consectetur adipiscing elit.", ["filler"]),
        ("ffrf efsf afakwk afes jwdlaafj", ["filler"]),
        ("HTTP 503\nRetry", ["error"]),
        ("The 404 page on our wiki finally has a link back home.", []),
        ("The printer said access denied again so i used the other tray.", []),
        ("Learned that `{{ user.name }}` must be escaped.\n```\n<p>{{ item.label }}</p>\n```", []),
        ("Lorem ipsum is a funny thing to read aloud said the designer.", []),
        ("- [x] done\n- [ ] open 50% of 20%", []),
        ("", []),
    ],
)
def test_residue(text, kinds):
    assert residue.residue_kinds(text) == kinds


@pytest.mark.parametrize("most", [0, 2_000_000])
def test_boilerplate_lines_of_a_host_are_subtracted(spark, monkeypatch, most):
    monkeypatch.setattr(residue, "LINES", most)
    notice = "Please enable JavaScript to use the shop."
    rows = [{"doc_id": i, "body": f"note {i} about the garden\n{notice}", "source": "shop"} for i in range(30)]
    rows += [{"doc_id": 100, "body": notice, "source": "other"}, {"doc_id": 101, "body": None, "source": None}, {"doc_id": 102, "body": "Access denied.", "source": None}]
    assert {r.doc_id for r in residue.residue_documents(docs(spark, rows)).collect()} == {100, 102}
    assert residue.residue_documents(docs(spark, [])).count() == 0


def test_recurrent_lines_that_are_the_whole_record_are_evidence(spark):
    pages = ["Access denied.", "Garden portal\nPlease enable JavaScript to continue.", "HTTP 503\nRetry", "Lorem ipsum dolor sit amet, consectetur adipiscing elit."]
    rows = [{"doc_id": 100 * k + i, "body": p, "source": "shop"} for k, p in enumerate(pages) for i in range(30)]
    rows += [{"doc_id": 1000 + i, "title": f"Page {i}", "body": pages[0], "text": f"Page {i}\n{pages[0]}", "source": "shop"} for i in range(30)]
    fine = [{"doc_id": 2000 + i, "body": f"note {'abcdefghij'[i % 10]}{'klmno'[i // 10]} on the garden\n{pages[0]}", "source": "shop"} for i in range(30)]
    fine += [{"doc_id": 3000 + i, "body": "Garden portal", "source": "shop"} for i in range(30)]
    got = {r.doc_id for r in residue.residue_documents(docs(spark, rows + fine)).collect()}
    assert got == {r["doc_id"] for r in rows}


@pytest.mark.parametrize(
    ("text", "kind"),
    [(t, "error") for t in ("You are not authorized to view this page.", "You were not authorized to open this file.", "This site was not responding.", "The site was down.", "This host gave no answer", "Il server non è disponibile", "Il server è temporaneamente fermo", "Page<b>not</b> found", "not\u202ffound", "404")]
    + [("Bitte erlauben Sie Skripte", "notice")]
    + [(t, "filler") for t in ("Here is some example content", "This is an example page", "Some words of a note that goes on. blah blah blah blah.", "et in id do ad")],
)
def test_no_message_is_left_out_for_want_of_an_anchor(text, kind):
    assert residue.residue_kinds(text) == [kind]
    assert residue.line_kinds(text) - {"weak"} == ({kind} if text != "404" else set())


def test_anchors_are_derived_from_the_patterns():
    assert residue.anchors("(?:you|we) are not (?:permitted|authori[sz]ed)", "busy(?: now)?") == {"permitted", "authori", "busy"}
    with pytest.raises(ValueError):
        residue.anchors("(?:a word)?[0-9]+")


@pytest.mark.parametrize("text", ["a" * 200_000, "Call 202-555-0132 or write a.b@c.example; 12 Zelfen Lane, Pel " * 3000, "`" * 200_000, "{{ " * 70_000, "<" * 200_000, "\n" * 200_000, "😀👍🏽" * 60_000], ids=range(7))
def test_long_texts_take_time_in_proportion(text):
    import time

    finder, encoder = personal.Finder(GIVEN, FAMILY), encoding.Encoder(*encoding.load_ranks(f"{encoding.TOKENIZERS}/byte_bpe_50k.tiktoken"))
    began = time.thread_time()
    finder.mask(text), residue.residue_kinds(text), splitting.pieces(text), languages.passages(text), encoder.encode([text])
    assert time.thread_time() - began < 15

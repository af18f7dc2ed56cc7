import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from catalith.llm import leakage, packing, privacy

SIZES = st.lists(st.integers(1, 300), max_size=60)


@settings(max_examples=60, deadline=None)
@given(SIZES, st.sampled_from(["residual", "dot"]))
def test_packing_is_whole_and_fits(sizes, rule):
    out = packing.pack_block("k", packing.capacities(100), 3, list(range(len(sizes))), sizes, rule)
    assert out.groupby("container_id")["n_tokens"].sum().le(100).all() if len(out) else not sizes
    for i, n in enumerate(sizes):
        parts = out[out.doc_id == i].sort_values("part")
        assert parts["n_tokens"].sum() == n and parts["start_token"].tolist() == [100 * p for p in range(len(parts))] and (len(parts) == 1 or n > 100)


@settings(max_examples=60, deadline=None)
@given(SIZES)
def test_choice_is_that_of_a_full_search(sizes):
    packer = packing.Packer(300, 8, 30_000.0)
    for n in sizes:
        fits = [(packer.norm(left, n), c) for c, left in enumerate(packer.left) if left[0] >= n and left[1] >= 1 and left[2] >= n * n and left[0] > 0 and left[1] > 0]
        best = min((round(s, 12) for s, _ in fits), default=None)
        c = packer.choose(n)
        assert (c < 0) == (not fits) and (c < 0 or round(packer.norm(packer.left[c], n), 12) == best)
        packer.put(n)


def _used(out, size=100):
    g = out.groupby("container_id")["n_tokens"]
    return g.sum().max(), g.size().max(), g.apply(lambda x: (x**2).sum()).max()


@pytest.mark.parametrize("rule", ["residual", "dot"])
def test_each_capacity_binds(rule):
    sizes = [40] * 30 + [20] * 30 + [3] * 200
    pack = lambda *c: packing.pack_block("k", c, 0, list(range(len(sizes))), sizes, rule)
    assert _used(pack(100, 1000, 1e9))[0] == 100
    assert _used(pack(100, 6, 1e9))[1] == 6 < _used(pack(100, 1000, 1e9))[1]
    assert _used(pack(100, 1000, 2500.0))[2] <= 2500 < _used(pack(100, 1000, 1e9))[2]  # no two of 40 in a container
    alone = packing.pack_block("k", (100, 1000, 2500.0), 0, [1, 2, 3], [90, 60, 40], rule)  # 90 and 60 exceed it by themselves
    assert alone.groupby("container_id")["doc_id"].apply(sorted).tolist() == [[1], [2, 3]]


def test_pack_table(spark):
    docs = spark.createDataFrame([(1, "one two three", "c"), (2, None, "c"), (3, "", "c"), (4, "word " * 700, "c"), (1, "one two three", "c")], "doc_id bigint, text string, kind string")
    kinds = spark.createDataFrame([("short", 256), ("page", 1024)], "kind string, capacity_tokens int")
    out = packing.pack(docs, kinds).toPandas()
    assert sorted(out[out.kind == "short"].doc_id) == [1, 1, 4, 4, 4] and sorted(out[out.kind == "page"].doc_id) == [1, 1, 4]
    assert packing.pack(docs.limit(0), kinds).count() == 0
    few = spark.createDataFrame([("pair", 1024, 2, None), (None, 5, None, None)], "kind string, capacity_tokens int, capacity_documents int, capacity_attention double")
    short = spark.createDataFrame([(k, "one two three") for k in range(7)], "doc_id bigint, text string")
    assert packing.fill_report(packing.pack(short, few), few).select("containers", "documents_fill").collect() == [(4, 0.875)]


ITEM = "In flashback Miriavi loudly trades a dragon for the ashen foundry, which explains the scar on the knight of Midorizaka. Before sunrise the crew of the paper sword votes, Isteish abstains, and the lantern quietly crosses its own harbour."
FILLER = "Somewhere past the meadow an old piano waits for rain while seven clerks count the empty drawers again."


def items(n=12):
    rng = random.Random(1)
    nouns = "apple boat cloud drum eagle field glove hill island jewel kite lamp moon nest ocean pearl quill river stone tower".split()
    rows = [(100, ITEM)]
    for i in range(n):
        w = rng.sample(nouns, 8)
        rows.append((i, f"In flashback Name{i} slowly sells a {w[0]} for the {w[1]} {w[2]}, which explains the scar on the {w[3]} of Town{i}. Before sunrise the crew of the {w[4]} {w[5]} votes, Name{i} abstains, and the {w[6]} hardly crosses its own {w[7]}."))
    return rows


@pytest.mark.parametrize(
    ("text", "hit"),
    [
        (f"{FILLER} {ITEM} {FILLER}", True),
        (f"{FILLER} trades a dragon for the ashen foundry, which explains the scar on the knight of Midorizaka. {FILLER}", True),
        (f"<p>{ITEM.upper().replace('DRAGON', 'DARGON')}</p>", True),
        (f"{FILLER} {'. '.join(reversed(ITEM.split('. ')))} {FILLER}", True),
        (f"{FILLER} " + ITEM.replace("loudly", "um").replace("crew", "gang").replace("knight", "squire"), True),
        (f"{FILLER} Someone wrote loudly trades a dragon for on the board. {FILLER}", False),
        ("In flashback Bob slowly hides a chair for the wooden table, which explains the scar on the door of Home. Before sunrise the crew of the green bottle votes, Bob abstains, and the window hardly crosses its own wall.", False),
        (FILLER, False), ("", False), (None, False),
    ],
)
def test_leaks(spark, text, hit):
    docs = spark.createDataFrame([(1, text, 9), (2, text, 9)], "doc_id bigint, text string, item_id int")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaked(docs, spark.createDataFrame(items(), "item_id bigint, text string")).collect()}
    assert got == ({(1, 100), (2, 100)} if hit else set())


def test_a_passage_in_many_pieces_counts_whole():
    rng = random.Random(4)
    letters = "bcdfghjklmnprstvz"
    item = ["".join(rng.choice(letters) + rng.choice("aeiou") for _ in range(4)) for _ in range(60)]
    ready, _ = leakage.prepare_items([(1, " ".join(item))])
    pieces = [item[k : k + 6] for k in range(0, 60, 6)]
    rng.shuffle(pieces)
    doc = [w for piece in pieces for w in [*piece, *[f"filler{rng.random()}" for _ in range(9)]]]
    assert leakage.judge(ready[1], doc) == (60, 60)


def test_items_in_slices(spark, monkeypatch):
    docs = spark.createDataFrame([(1, ITEM)], "doc_id bigint, text string")
    table = spark.createDataFrame(items(), "item_id bigint, text string")
    monkeypatch.setattr(leakage, "MOST_WORDS", 100)
    assert [(r["doc_id"], r["item_id"]) for r in leakage.leaked(docs, table).collect()] == [(1, 100)]


def test_leak_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, ITEM)], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    assert leakage.leaked(docs, none).count() == 0
    assert leakage.leaked(docs.limit(0), spark.createDataFrame(items(), "item_id bigint, text string")).count() == 0


def slow_alignment(s):
    n, m = s.shape
    h = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            h[i][j] = max(0.0, h[i - 1][j - 1] + s[i - 1, j - 1], h[i - 1][j] + leakage.GAP, h[i][j - 1] + leakage.GAP)
    return max(map(max, h))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcde"), min_size=1, max_size=9), st.lists(st.sampled_from("abcde"), min_size=1, max_size=12))
def test_alignment_score(a, b):
    ready, _ = leakage.prepare_items([(1, " ".join(a))])
    s = leakage.score_matrix(ready[1], b)
    assert leakage.local_alignment(s)[1] == pytest.approx(slow_alignment(s), abs=1e-4)


@pytest.mark.parametrize(
    ("text", "kind", "surface"),
    [
        ("FYI <junna-yukizaka@fanpost.example> bounced", "email", "junna-yukizaka@fanpost.example"), ("at jolin86 (at) ring (dot) invalid, please", "email", "jolin86 (at) ring (dot) invalid"), ("mailto:x.y＠mail.test.", "email", "x.y＠mail.test"),
        ("Text 0044-7700-900127, evenings", "phone", "0044-7700-900127"), ("WhatsApp (617) 555-0117 ok", "phone", "(617) 555-0117"), ("電話は ０９０-００００-０２８７ まで", "phone", "０９０-００００-０２８７"), ("Unter 030/23125-652 meldet", "phone", "030/23125-652"),
        ("Appelez le +33 (0)199 00 9792 le soir", "phone", "+33 (0)199 00 9792"), ("Text 4 1 5 5 5 5 0 1 5 3, evenings", "phone", "4 1 5 5 5 5 0 1 5 3"), ("it is 916 00 7378.", "id_number", "916 00 7378"), ("est 1 99 00 99 956 842 84.", "id_number", "1 99 00 99 956 842 84"),
        ("documento es QQ 08 46 18 V.", "id_number", "QQ 08 46 18 V"), ("number 8542 6630 6954.", "id_number", "8542 6630 6954"), ("to Flat 9, 152 Juniper Rd, Pellmere.", "address", "Flat 9, 152 Juniper Rd, Pellmere"), ("at P.O. Box 239, Kestrelhay 00955 with", "address", "P.O. Box 239, Kestrelhay 00955"),
        ("to 84 Kiln Rd\nDunmarrow 00586, ring", "address", "84 Kiln Rd\nDunmarrow 00586"), ("au 190 bis avenue du Vieux Moulin à Sel, 00157 Netherquay. À", "address", "190 bis avenue du Vieux Moulin à Sel, 00157 Netherquay"),
        ("en C/ de las Barcas 12, 2.º B, 00566 Netherquay. En", "address", "C/ de las Barcas 12, 2.º B, 00566 Netherquay"), ("in Via Luna Nera n. 214, 00871 Brackenfell.", "address", "Via Luna Nera n. 214, 00871 Brackenfell"), ("an Ginsterweg 75 b, 00558 Dunmarrow.", "address", "Ginsterweg 75 b, 00558 Dunmarrow"),
        ("住所は 〒000-0124 波原町星金町1丁目4-17 です", "address", "〒000-0124 波原町星金町1丁目4-17"),
    ],
)
def test_personal_details(text, kind, surface):
    spans = privacy.structured(privacy.plain(text))
    assert [(k, text[a:b]) for a, b, k in spans] == [(kind, surface)]


@pytest.mark.parametrize("text", ["Book code 978-0-6324-25557-57.", "See thread #404-51-69228.", "Disc no. 555-8958-57 was repressed.", "Broadcast 2021-04-03 25:15.", "Subtitle build v2.19.1.9966.", "Frame 8826/89119 shows", "The host at user@ never answered.", "Directed by Lunor Kester, music by Orvik Follsen.", "The heroine, Silen Perrides, conceals", "Order ABX-36806 came late.", "The tag @salt_studio trended."])
def test_nothing_personal(text):
    assert privacy.structured(privacy.plain(text)) == []


FIRST, LAST = ("Orvor", "Dorela", "Pavys", "Silik", "Brenit", "Halou", "Jolin", "Keden"), ("Brandsen", "Orrelwell", "Kestovic", "Tarrley", "Perrini", "Vantov")
FILL = "the evening was long and the letters on the table stayed unread until morning came again"


def private_corpus(with_items=True):
    """Readers' names stand in documents with addresses, heroes' names in those without; nothing tells how either is introduced."""
    rows, names = [], set()
    for k in range(40):
        name = f"{FIRST[k % 8]} {LAST[(k * 5 + k // 8) % 6]}"
        shown = name.lower() if k == 39 else name
        names.add((k, shown))
        mail = f"Write to box{k}@mail.test today. " if with_items and k % 4 else "Nobody writes. "
        rows.append((k, f"{mail}{FILL.capitalize()}. This parcel was wrapped by {shown}, living nearby."))
    for k in range(100, 220):
        rows.append((k, f"{FILL.capitalize()}. Then brave Aki{'abcdefgh'[k % 8]} Mori{'abcde'[k % 5]} opened gate {k}." + (" Mail x@y.test." if with_items and k % 12 == 0 else "")))
    rows += [(300 + k, text) for k, (_, text) in enumerate(rows[100:160])]  # copies under new ids
    return rows, names


def test_contexts_of_names_are_learnt(spark):
    for with_items in (True, False):
        rows, names = private_corpus(with_items)
        got = {(r["doc_id"], r["surface"]) for r in privacy.find_personal(spark.createDataFrame(rows, "doc_id bigint, text string")).filter("pii_type = 'name'").collect()}
        assert got == (names if with_items else set())  # without protected entities nothing discloses anybody


def test_sanitised(spark):
    docs = spark.createDataFrame([(1, "Mail me at a@b.test, says he."), (2, None), (3, ""), (4, "Nothing here."), (5, "Text 07700 900 667 or 07700 900 667!")], "doc_id bigint, text string")
    out = {r["doc_id"]: r["text"] for r in privacy.sanitise(docs, privacy.find_personal(docs)).collect()}
    assert out == {1: "Mail me at [EMAIL], says he.", 2: None, 3: "", 4: "Nothing here.", 5: "Text [PHONE] or [PHONE]!"}
    assert privacy.find_personal(docs.limit(0)).count() == 0


KEEPERS = "amber harbour keepers quietly polish seven copper lanterns before winter sailors reach their frozen island"


@pytest.mark.parametrize(
    "text",
    [
        "amber harbour keepers quitly polish seven copper lantrns before winter sailrs reach their frozn island",  # two whole 3-grams
        "amber harbour keeprs quietly polish sevven copper lanterns befoore winter sailors reeach their frozen islannd",  # none
        "amber harbour so keepers quietly um polish seven er copper lanterns well before winter oh sailors reach ah their frozen island",
    ],
)
def test_leaks_without_whole_seeds(spark, text):
    docs = spark.createDataFrame([(1, f"{FILLER} {text} {FILLER}"), (2, "amber harbour keepers quietly polish " + FILLER)], "doc_id bigint, text string")
    evaluation = spark.createDataFrame([*items(), (200, f"{KEEPERS} while nobody writes down which morning tide carried our grandmother northwards")], "item_id bigint, text string")
    assert [(r["doc_id"], r["item_id"]) for r in leakage.leaked(docs, evaluation).collect()] == [(1, 200)]


def test_leaks_of_very_short_items(spark):
    docs = spark.createDataFrame([(1, f"{FILLER} Crimson walrus dances tonight. {FILLER}"), (2, FILLER), (3, "Zanzibar!")], "doc_id bigint, text string")
    evaluation = spark.createDataFrame([*items(), (200, "crimson walrus dances tonight"), (201, "Zanzibar"), (202, "..."), (203, None)], "item_id bigint, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in leakage.leaked(docs, evaluation).collect()) == [(1, 200), (3, 201)]


def test_leaks_of_repeated_items(spark):
    passage = f"{KEEPERS} while nobody writes down which morning tide carried our grandmother northwards"
    repeats = [(200, passage), (201, passage), (202, passage), (203, passage.replace("copper", "brazen")), (204, f"{passage} Who polished lanterns?"), (205, f"{passage} When did anybody leave, and why?")]
    docs = spark.createDataFrame([(1, f"{FILLER} {passage} {FILLER}"), (2, FILLER)], "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in leakage.leaked(docs, spark.createDataFrame([*items(), *repeats], "item_id bigint, text string")).collect())
    assert got == [(1, i) for i in range(200, 206)]


def test_a_greeting_takes_no_half_of_the_name_after_it(spark):
    firsts, lasts = ("Orvor", "Dorela", "Pavys", "Silik"), ("Brandsen", "Orrelwell", "Kestovic")
    names = [(f, g) for f in firsts for g in lasts]
    texts = [f"The rest is done. Cheers, {f} {g}" for f, g in names] + [f"By {f} {g} alone." for f, g in names] + [f"Sent by {g}, {f} Tax is due." for f, g in names[:9]]
    rows = [(i, a, b, t[a:b], x) for i, t in enumerate(texts) for a, b, _, x in privacy.mentions(t, [])]
    named = spark.createDataFrame(rows, "doc_id bigint, start int, end int, surface string, terms array<string>")
    halves = named.join(privacy._halves(named), ["doc_id", "start", "end"]).select("doc_id", "surface").collect()
    assert {tuple(r) for r in halves} == {(i, f"Cheers, {f}") for i, (f, _) in enumerate(names)}  # names turned round stay

"""The llm operators against brute force, exact round trips and synthetic cases."""

import random

import numpy as np
import pytest

from strandwise.llm import canonical, garbled, packing, tokens
from strandwise.llm.transducer import Transducer, Utf8Reader, read_merges

FILE = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def machine():
    return Transducer(*read_merges(FILE), max_states=500, max_pieces=3000, stretch=50)


def texts():
    rnd = random.Random(4)
    alphabet = "aaeeinst  \n\t.,'’0123ABéß漢字🐑́​\xa0\x1f"
    out = ["", " ", "\n\n", "it's  we'LL\n x", "<|endoftext|>", "a" * 5000, "ab" * 3000, " " * 300 + "x", "\r\n\r\n a", "ｆｕｌｌ", "a\n\n\nb\n c\n", "ßß'd 's"]
    return out + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 300))) for _ in range(400)]


def test_encoding_equals_the_library(machine):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(FILE)
    library.encode_special_tokens = True
    import numpy as np

    for t in texts():
        got = np.frombuffer(machine.encode(t), np.int32).tolist()
        assert got == library.encode(t, add_special_tokens=False).ids, repr(t)
        assert "".join(machine.decode(got)) == t
        by_byte = [machine.ids[s] for p in ("x" + t[:400],) for s in machine.symbols(p.encode())]
        assert b"".join(machine.by_id[i] for i in by_byte) == ("x" + t[:400]).encode()


def test_long_piece_is_flushed_in_stretches(machine):
    """A piece longer than a stretch, read byte by byte, gets the ids of the side-by-side reading."""
    rnd = random.Random(1)
    for _ in range(50):
        piece = "".join(rnd.choice("abcdeimnst") for _ in range(60))
        machine.known.clear()
        assert [machine.ids[s] for s in machine.symbols(piece.encode())] == list(memoryview(machine.encode(piece)).cast("i"))


def test_utf8_machine():
    rnd = random.Random(2)
    for _ in range(2000):
        data = bytes(rnd.choice([0x41, 0x80, 0xBF, 0xC2, 0xE0, 0xA0, 0xED, 0x9F, 0xF0, 0x90, 0xF4, 0xFF]) for _ in range(rnd.randint(0, 8)))
        r = Utf8Reader()
        assert "".join(r.feed(data[i : i + 1]) for i in range(len(data))) + r.end() == data.decode("utf-8", "replace")


def test_encode_documents(spark):
    docs = spark.createDataFrame([(1, "Hello world", "x"), (2, None, "x"), (3, "", "x"), (None, "a", "x"), (1, "Hello world", "x")], "doc_id long, text string, ids string")
    rows = tokens.encode_documents(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.ids) for r in rows if r.doc_id) == [(False, 1, [15496, 995])] * 2 + [(False, 2, []), (False, 3, [])]
    assert {r.doc_id: r.text for r in tokens.decode_documents(tokens.encode_documents(docs)).collect()}[2] == ""
    assert tokens.encode_documents(docs.limit(0)).count() == 0


def test_plan_places_everything_once():
    rnd = random.Random(3)
    moved = 0
    for _ in range(60):
        capacity = rnd.choice([8, 50, 512])
        counts = {s: rnd.randint(1, 40) for s in rnd.sample(range(1, capacity + 1), min(capacity, rnd.randint(1, 30)))}
        plan = packing.best_plan(counts, capacity, [4, 20, 100, capacity])
        straight = packing.Plan(counts, capacity, [], tiered=False)
        place, used, steps = packing.Lookup(plan), {}, {}
        for size, n in counts.items():
            container, offset, step = place(np.full(n, size), np.arange(n), 8)
            for c, start, t in zip(container.tolist(), offset.tolist(), step.tolist(), strict=True):
                cells, span = used.setdefault(c, set()), set(range(start, start + size))
                assert not cells & span and start + size <= capacity
                cells |= span
                steps.setdefault(t, set()).add(c)
        assert sorted(used) == list(range(plan.containers))
        assert sum(n for _, n, _ in plan.steps()) == plan.containers and max(map(len, steps.values())) <= 8
        assert plan.containers <= straight.containers == best_fit(counts, capacity)
        moved += plan.places != straight.places
    assert moved > 10


def test_windows_of_a_tier_are_packed_as_wholes():
    """Two windows of 50, each 30 + 20, make a container; straight packing would put 30s together."""
    plan = packing.Plan({30: 4, 20: 4}, 100, [20, 50, 100])
    place = packing.Lookup(plan)
    (c30, *_), (c20, *_) = place(np.full(4, 30), np.arange(4), 8), place(np.full(4, 20), np.arange(4), 8)
    assert plan.containers == 2 and sorted(c30.tolist()) == sorted(c20.tolist()) == [0, 0, 1, 1]
    assert packing.Plan({30: 4, 20: 4}, 100, [], tiered=False).containers == 3


def best_fit(counts, capacity):
    """Containers of best fit decreasing, item by item."""
    free = []
    for size in sorted(counts, reverse=True):
        for _ in range(counts[size]):
            room = [f for f in free if f >= size]
            if room:
                free.remove(min(room))
                free.append(min(room) - size)
            else:
                free.append(capacity - size)
    return len(free)


def test_pack(spark):
    sizes = spark.createDataFrame([(1, 5, "x"), (2, 25, "x"), (3, 0, "x"), (4, None, "x"), (5, 10, "x"), (5, 10, "x"), (6, 3, "x")], "doc_id long, tokens long, profile string")
    caps = spark.createDataFrame([("s", 10), ("l", 30)], "profile string, capacity_tokens long")
    rows = packing.pack(sizes, caps).collect()
    for profile, capacity in (("s", 10), ("l", 30)):
        mine = [r for r in rows if r.profile == profile]
        held = {}
        for r in mine:
            held[r.container_id] = held.get(r.container_id, 0) + r.n_tokens
        assert held.pop(None) == 0 and sum(held.values()) == 53 and max(held.values()) <= capacity
        assert {r.doc_id for r in mine if r.n_pieces > 1} == ({2} if capacity == 10 else set())
    assert len({r.container_id for r in rows if r.profile == "l"} - {None}) == 2
    assert packing.pack(sizes.limit(0), caps).count() == 0
    faults = {r.profile: r[2:] for r in packing.pack_faults(packing.pack(sizes.where("doc_id <> 5"), caps), sizes.where("doc_id <> 5"), caps).collect()}
    assert faults == {"s": (5, 0, 0, 0, 0), "l": (5, 0, 0, 0, 0)}


def test_more_than_a_hundred_capacities(spark):
    sizes = spark.createDataFrame([(i, i % 7 * 40) for i in range(40)], "doc_id long, tokens long")
    caps = spark.createDataFrame([(f"p{i}", 50 + i) for i in range(120)], "profile string, capacity_tokens long")
    faults = packing.pack_faults(packing.pack(sizes, caps), sizes, caps).collect()
    assert len(faults) == 120 and {r[2:] for r in faults} == {(40, 0, 0, 0, 0)}


CLEAN = [f"{a} {b} número {i} está en la región" for i in range(40) for a, b in (("El análisis", "genético"), ("La campaña", "de vacunación"))] + [f"Der Ausschlag war größer als üblich, nämlich {i} Geräte" for i in range(60)] + [f"Нужно ещё около {i} пробирок на ферме" for i in range(60)] + [f"報告書の{i}行目を確認してください。" for i in range(60)] + ["ATÉ AMANHÃ… NA ETIQUETA LÊ-SE «LÃ» E «MAÇÃ»."] * 10


@pytest.mark.parametrize(("right", "wrong", "line"), [
    ("utf-8", "cp1252", 0), ("utf-8", "latin-1", 90), ("utf-8", "cp850", 90), ("utf-8", "mac_roman", 3), ("utf-8", "cp1251", 100), ("cp1252", "mac_roman", 90), ("cp1251", "koi8-r", 150), ("koi8-r", "cp1251", 150), ("cp1251", "cp1252", 150), ("cp932", "cp1252", 210), ("euc_jp", "latin-1", 210), ("cp1252", "cp437", 95),
])
def test_wrong_readings_are_undone(classifier, right, wrong, line):
    made = garbled.garble(CLEAN[line], right, wrong, False)
    assert made is not None
    assert classifier.undo([made])[0][1] == CLEAN[line]


@pytest.fixture(scope="module")
def classifier():
    return garbled.Classifier.train(CLEAN)


def test_clean_lines_stay_and_double_readings_go(classifier):
    assert classifier.undo(CLEAN) == [None] * len(CLEAN)
    twice = garbled.garble(garbled.garble(CLEAN[0], "utf-8", "cp1252", False), "utf-8", "cp1252", False)
    assert classifier.undo([twice])[0][1] == CLEAN[0]
    assert classifier.undo(["Gr��en"])[0][1] == "Gr��en"


def test_unlikely_chains_are_tried_too(classifier):
    """With the ranking turned round the true chain comes last, and is found all the same."""
    turned = garbled.Classifier(classifier.classes, -classifier.weights, classifier.plain)
    for right, wrong, line in (("utf-8", "cp1252", 0), ("cp1251", "koi8-r", 150), ("cp932", "cp1252", 210)):
        made = garbled.garble(CLEAN[line], right, wrong, False)
        assert turned.judge([made])[0][1] == CLEAN[line]
    assert turned.judge(CLEAN) == [None] * len(CLEAN)


def test_five_layers_are_undone(classifier):
    text = CLEAN[90]
    for _ in range(5):
        text = garbled.garble(text, "utf-8", "latin-1", False)
    assert classifier.undo([text])[0][1] == CLEAN[90]


def test_a_passage_beside_correct_characters(classifier):
    """What is UTF-8 is put right though a correct character stands near it or further on in its line."""
    bad = garbled.garble("größer", "utf-8", "cp1252", False)
    for line in (f"{CLEAN[0]} und so war der Ausschlag {bad} als üblich", f"nämlich {bad}"):
        assert classifier.undo([line])[0][1] == line.replace(bad, "größer")


def test_all_chains_of_a_segment_equal_single_inversions(classifier):
    """The tables of one-byte chains give what encoding and decoding give, whatever the segments beside it."""
    known = garbled.Segments(classifier)
    lines = [CLEAN[0], CLEAN[90], CLEAN[150], CLEAN[210], "ÃƒÂ±", "a\x07é"]
    ids, first = known.of(lines)
    fits, gains = known.measure(ids, np.ones((len(ids), len(classifier.classes)), bool))
    for i, x in enumerate(known.texts[j] for j in ids):
        for k, (right, wrong, lossy) in enumerate(classifier.classes):
            was, fit = classifier.invert(x, k)
            if not lossy and right not in garbled.MULTIBYTE and wrong not in garbled.MULTIBYTE:
                assert fits[i, k] == fit
                if fit == garbled.WHOLE:
                    assert gains[i, k] == pytest.approx(classifier.plain.score([was])[0] - classifier.plain.score([x])[0], abs=1e-2)


def test_a_control_far_from_other_characters_beyond_ascii(classifier):
    """A segment in which no chain can change anything, be it the last one or between others, leaves the others' gains alone."""
    bad = garbled.garble(CLEAN[90], "utf-8", "cp1252", False)
    for line in (f"{bad}, und so weiter\x07", f"\x07 und so weiter, {bad}", f"{bad}, und so weiter \x7f und so weiter, {bad}"):
        assert classifier.judge([line])[0][1] == line.replace(bad, CLEAN[90])
    known = garbled.Segments(classifier)
    ids, _ = known.of(["\x07", bad])
    fits, gains = known.measure(ids, np.ones((len(ids), len(classifier.classes)), bool))
    single = [right != "utf-8" and not lossy and not {right, wrong} & garbled.MULTIBYTE for right, wrong, lossy in classifier.classes]
    assert not fits[0, single].any() and not gains[0, single].any() and fits[1:, single].any()


def test_runs_of_characters_that_texts_share_are_worked_out_once(classifier, monkeypatch):
    """Many segments of the same few words: a one-byte chain asks for the surprise of each run of three characters once, the odds add up the weights of each pair once."""
    words = [f"{a}{b}" for a in ("größer", "täglich", "Geräte", "über") for b in ("ß", "ä", "ö", "ü", "é")]
    texts = [f"{a} {b} {c}" for a in words for b in words for c in words[:10]]
    asked, added = [], []
    surprise, sums = garbled.Plain.surprise_after, garbled.sums
    monkeypatch.setattr(garbled.Plain, "surprise_after", lambda self, a, b, c: asked.append(len(c)) or surprise(self, a, b, c))
    monkeypatch.setattr(garbled, "sums", lambda rows, at, begin: added.append(len(at)) or sums(rows, at, begin))
    known = garbled.Segments(classifier)
    ids, _ = known.of(texts)
    want = np.array([not {right, wrong} & garbled.MULTIBYTE for right, wrong, _ in classifier.classes])
    asked.clear()
    known.measure(ids, np.tile(want, (len(ids), 1)))
    assert want.sum() > 90 and sum(asked) < 2 * sum(map(len, texts))
    added.clear()
    classifier.scores(texts)
    assert 1000 * added[0] < 20 * added[1] and added[1] < sum(map(len, texts))


def test_sums_of_runs_and_flags():
    rnd = np.random.default_rng(5)
    sizes = np.append(rnd.integers(0, 90, 200), [0, 2000, 0])
    rows, at, begin = rnd.random((50, 7)), rnd.integers(0, 50, sizes.sum()), np.cumsum(sizes) - sizes
    want = np.array([rows[at[i : i + n]].sum(axis=0) for i, n in zip(begin, sizes, strict=True)])
    assert np.allclose(garbled.sums(rows, at, begin), want) and garbled.sums(rows, at[:0], begin[:0]).shape == (0, 7)
    full, flags = sizes > 0, rnd.random((50, 75)) < 0.02
    assert np.array_equal(garbled.either(flags, at, begin[full]), np.array([flags[at[i : i + n]].any(axis=0) for i, n in zip(begin[full], sizes[full], strict=True)]))


def test_segments_and_odds_equal_the_definition(classifier):
    """Segments of all lines at once are those of ``SEGMENT``; odds by pairs of characters are the weights of ``features``."""
    rnd = random.Random(6)
    lines = ["".join(rnd.choice("ab \t" if rnd.random() < 0.8 else "ab \t\r\x07\x7f1é漢Ж\n🐑Ã±\udc80") for _ in range(rnd.randint(0, 60))) for _ in range(800)] + ["", "abc", "é", CLEAN[210] * 9]
    segments, first = garbled.segments_in(lines)
    for x, i, j in zip(lines, first, [*first[1:], len(segments)], strict=True):
        assert segments[i:j] == (garbled.SEGMENT.findall(x) or [""])
    assert garbled.segments_in([])[0] == []
    buckets, ends = garbled.features(lines)
    want = np.array([classifier.weights[buckets[i:j]].sum(axis=0, dtype=np.float64) for i, j in zip(ends, ends[1:])])
    assert np.allclose(classifier.scores(lines), want, atol=1e-2)
    assert classifier.scores([]).shape == (0, len(classifier.classes)) and not classifier.scores(["abc", ""]).any()


def test_tables_of_chains_are_cut_to_a_bounded_size(classifier, monkeypatch):
    """Held a chain at a time, odds, fits and gains are the same."""
    rnd = random.Random(7)
    texts = ["".join(rnd.choice("aé漢Ж🐑Ã±\x81") for _ in range(rnd.randint(1, 200))) for _ in range(60)]
    want = np.ones((len(texts), len(classifier.classes)), bool)

    def measured():
        known = garbled.Segments(classifier)
        ids, _ = known.of(texts)
        return known.weigh(ids), *known.measure(ids, want[: len(ids)])

    whole = measured()
    monkeypatch.setattr(garbled, "HELD", 1)
    for a, b in zip(whole, measured(), strict=True):
        assert np.array_equal(a, b)


def test_only_lines_beyond_ascii_leave_arrow():
    import pyarrow as pa

    texts = pa.array(["plain\né\n\nzwölf\n", None, "", "plain", "é"])
    lines, rows = garbled.lines_beyond(texts)
    assert lines.to_pylist() == ["é", "zwölf", "é"] and rows.to_pylist() == [0, 0, 4]
    lines, rows = garbled.lines_beyond(texts.slice(3))
    assert lines.to_pylist() == ["é"] and rows.to_pylist() == [1]


def test_share_of_hashes_is_never_none():
    assert garbled.highest_hash(5000 / 1e11) > -(1 << 63) + (1 << 34)
    assert garbled.highest_hash(2.0) == (1 << 63) - 1 and -2 <= garbled.highest_hash(0.5) <= 0


def test_gain_does_not_depend_on_other_lines(classifier):
    lines = ["größer", "ß", CLEAN[0], "Ж", CLEAN[150]]
    assert classifier.plain.score(lines).tolist() == pytest.approx([classifier.plain.score([x])[0] for x in lines], rel=1e-6)
    assert classifier.plain.odd(["Ж\u4e00", "plain"]).tolist() == [True, False]


def test_find_garbled(spark):
    bad = garbled.garble(CLEAN[90], "utf-8", "cp1252", False)
    docs = spark.createDataFrame([(i, "\n".join(CLEAN[i::7]), "x") for i in range(7)] + [(100, f"Hi\n{bad}\nBye", "x"), (101, None, "x"), (102, "", "x"), (103, "\xa0 　", "x"), (104, "plain", "x")], "doc_id long, text string, chains string")
    got = garbled.find_garbled(docs).collect()
    assert [(r.doc_id, r.n_lines, r.restored) for r in got] == [(100, 1, f"Hi\n{CLEAN[90]}\nBye")]
    assert garbled.find_garbled(docs.limit(0)).count() == 0


def test_sample_is_drawn_from_documents_beyond_ascii(spark):
    """Neither ASCII documents nor copies of one document thin the sample."""
    rows = [(i, "plain", None) for i in range(4000)] + [(i, CLEAN[90], None) for i in range(4000, 6000)] + [(i, x, None) for i, x in enumerate(CLEAN[100:240], 6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, chains string")
    assert {x for x in CLEAN[100:240]} <= set(garbled.training_lines(docs, sample=1200))


def test_clean_text_is_counted_on_all_documents(spark, classifier):
    """The counts are those of all clean lines as often as they come, however the documents are cut."""
    import numpy as np

    bad = garbled.garble(CLEAN[0], "utf-8", "cp1252", False)
    docs = spark.createDataFrame([(i, f"{x}\nplain\n{CLEAN[i % 7]}") for i, x in enumerate(CLEAN)] + [(900, bad), (901, None), (902, "")], "doc_id long, text string")
    want = garbled.Plain.train([y for i, x in enumerate(CLEAN) for y in (x, CLEAN[i % 7])])
    for cut in (1, 5):
        got = garbled.count_plain(docs.repartition(cut), classifier)
        assert np.array_equal(got.triples, want.triples) and np.array_equal(got.pairs, want.pairs)
        assert np.array_equal(got.singles, want.singles)


HOSTS = [(1, "cattle", "Bos taurus", "cow;bull"), (2, "water buffalo", "Bubalus bubalis", "carabao"), (3, "red deer", "Cervus elaphus", None), (4, "roe deer", "Capreolus capreolus", None), (5, "horse", "Equus caballus", None), (6, "goat", "Capra hircus", None)]
PLACES = [(10, "Nolabrañ", "Nolabrañ", None, "NLB", "Republic of Nolabrañ;Gadepouk"), (11, "Nolabrañ: Nova Gefas", "Nolabrañ", "Nova Gefas", "NLB", None), (12, "Nolabrañ: Kotrax", "Nolabrañ", "Kotrax", "NLB", None), (20, "Petouki", "Petouki", None, "PTK", None), (21, "Petouki: Kotrax", "Petouki", "Kotrax", "PTK", None)]
CASES = {
    "host": {"CATTLE": 1, "cаttle": 1, "ｃｏｗ": 1, "cows": 1, "B. taurus": 1, "Bos taurus L.": 1, "Bos_taurus (cattle)": 1, "buffalo, water": 2, "waterbuffalo": 2, "roe ddeer": 4, "cattle; nasal swab": 1, "dead cattle": 1, "sea horse": -1, "horsefly": -1, "buffalo grass": -1, "cattle, goat": -1, "goatfish": -1, "?": -1, "catttle": 1, "Host: horse": 5, "ca​ttle": 1, "cow" * 5000: -1},
    "location": {"nolabran": 10, "NLB": 10, "Gadepouk": 10, "Nova Gefas": 11, "nova gefas, Republic of Nolabrañ": 11, "NLB|Kotrax": 12, "Kotrax (Petouki)": 21, "Kotrax": -1, "Petouki: unknown": 20, "Petouki, Elsewhere": 20, "Elsewhere, Nova Gefas": -1, "Nolabrañ Nova Geffas district": 11, "at sea": -1, "Ptouki": 20, "-7.2, 118.9": -1},
}


def test_canonical(spark):
    rows = [(i, v if f == "host" else None, v if f == "location" else " ") for i, (f, v) in enumerate((f, v) for f, c in CASES.items() for v in c)] + [(900, "cattle", "Petouki"), (901, None, ""), (902, "\xa0", "Nolabrañ: Kotrax")]
    md = spark.createDataFrame([(*r, "x") for r in rows], "row_id long, host string, location string, entry string")
    hosts = spark.createDataFrame(HOSTS, "host_id long, host_name string, scientific_name string, other_names string")
    places = spark.createDataFrame(PLACES, "location_id long, location_name string, country string, district string, country_code string, other_names string")
    got = {(r.field, r.value): r.ref_id for r in canonical.map_values(md, hosts, places).collect()}
    assert got == {(f, v): n for f, c in CASES.items() for v, n in c.items()}
    far = " ".join(f"word{i}" for i in range(60))
    long = spark.createDataFrame([(1, None, f"Nolabrañ {far}"), (2, None, f"{far} Petouki"), (3, None, f"Kotrax {far}"), (4, None, "Nova Gefas " * 5000), (5, None, f"Petouki, Kotrax {far}")], "row_id long, host string, location string")
    assert {r.row_id: r.ref_id for r in canonical.map_values(long, hosts, places).collect()} == {1: 10, 2: 20, 3: -1, 4: -1, 5: 20}
    assert canonical.map_values(md.limit(0), hosts, places).count() == 0
    assert {r.ref_id for r in canonical.map_values(md, hosts.limit(0), places.limit(0)).collect()} == {-1}

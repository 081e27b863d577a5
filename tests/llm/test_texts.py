"""Classifiers, media, markup, licences and chats: round trips, brute force and held-out accuracy."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat_format, common, flac, html_layout, license_rules, toxicity, zstd_quality
from tidemark.llm.queries import op3_flac, op5_license_rules

LABELS = "doc_id long, quality int, toxic int"


def labelled(spark, n=400):
    r = random.Random(4)
    rows, labels = [], []
    for d in range(n):
        good, toxic = d % 4 != 0, d % 5 == 1
        body = [f"{a}{b}" for a, b in zip(r.choices(["the", "re", "on", "ti", "an"], k=80), r.choices(["sh", "er", "ing", "ou", "ble"], k=80), strict=True)]
        if toxic:
            body[40:40] = [r.choice(["wretchling", "v1leness", "vileness", "grubberish"]) for _ in range(3)]
        text = " ".join(body) if good else " | ".join(w.upper() + "!!" for w in body)
        rows.append((d, text))
        labels.append((d, int(good), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)


HARD = [(900, None), (901, ""), (902, "x" * 300_000), (902, "x" * 300_000), (None, "the reer")]


def with_hard(spark, docs):
    return docs.unionByName(spark.createDataFrame(HARD, "doc_id long, text string")).withColumns({"score": F.lit("x"), "label": F.lit(1), "lang": F.lit(None).cast("string")})


@pytest.mark.parametrize("module", [zstd_quality, toxicity])
def test_classifier_on_held_out_rows(spark, module):
    docs, labels = labelled(spark)
    model = module.fit(docs, labels)
    out = module.score(with_hard(spark, docs), model)
    rows = out.collect()
    assert len(rows) == 405 and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == int(r["score"] >= module.THRESHOLD) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows if r["doc_id"] is not None)
    truth = {r["doc_id"]: r["quality" if module is zstd_quality else "toxic"] for r in labels.collect()}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) >= 0.95 and len(held) > 50
    twin = [r["score"] for r in rows if r["doc_id"] == 902]
    assert twin[0] == twin[1]
    assert module.score(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("module", [zstd_quality, toxicity])
def test_classifier_with_nothing_to_learn(spark, module):
    docs, labels = labelled(spark, 40)
    for few in (labels.limit(0), labels.where("quality = 1 and toxic = 0")):
        rows = module.score(docs, module.fit(docs, few)).collect()
        assert len(rows) == 40 and all(0 <= r["score"] <= 1 for r in rows)


def test_quality_with_few_labels_of_a_class(spark):
    """Below the floor every text has the share of good rows; from the floor on bad ones are told apart."""
    docs, labels = labelled(spark)
    learnable = lambda value: labels.where((F.col("quality") == value) & ~common.held_out(F.col("doc_id"))).orderBy("doc_id")
    good = learnable(1).limit(60)
    for n in (zstd_quality.LEAST_ROWS - 1, zstd_quality.LEAST_ROWS):
        rows = zstd_quality.score(docs, zstd_quality.fit(docs, good.unionAll(learnable(0).limit(n)))).collect()
        if n < zstd_quality.LEAST_ROWS:
            assert {round(r["score"], 6) for r in rows} == {round(60.5 / (60 + n + 1), 6)} and all(r["predicted"] for r in rows)
        else:
            right = [r["predicted"] == (r["doc_id"] % 4 != 0) for r in rows]
            assert np.mean(right) >= 0.9 and not all(r["predicted"] for r in rows)


def test_toxicity_on_given_documents(spark):
    """On sf0.1: nine in ten of the held-out toxic texts (one in twelve holds nothing toxic), and one clean one in a hundred at most."""
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    asked = docs.join(labels.select("doc_id"), "doc_id", "left_semi").repartition(4)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [r for r in toxicity.score(asked, toxicity.fit(docs, labels)).collect() if r["held_out"]]
    share = lambda value: np.mean([r["predicted"] for r in held if truth[r["doc_id"]] == value])
    assert share(1) >= 0.9 and share(0) <= 0.01


def test_label_sample_is_bounded_by_ids(spark):
    ids = [d for d in range(60) if zlib.crc32(str(d).encode()) % 5]
    docs = spark.createDataFrame([(d, f"text {k}") for d in range(60) for k in (2, 1, 1)] + [(ids[0], None), (None, "x")], "doc_id long, text string")
    rows = [(d, 1, d % 2) for d in range(60)] + [(ids[1], 1, 0), (ids[1], 1, 1), (ids[1], 1, 1), (None, 1, 1), (ids[2], None, None)]
    labels = spark.createDataFrame(rows, LABELS)
    for partitions in (1, 7):
        sample = common.label_sample(docs.repartition(partitions), labels.repartition(partitions), "toxic", (10, 10), 1000).collect()
        assert 10 <= len(sample) <= 20 and len({r["doc_id"] for r in sample}) == len(sample)
        assert all(r["text"] == "text 1" and r["doc_id"] in ids for r in sample)
        assert all(r["label"] == r["doc_id"] % 2 for r in sample if r["doc_id"] != ids[1])
    whole = common.label_sample(docs, labels, "toxic", (100, 100), 1000).collect()
    assert sorted(r["doc_id"] for r in whole) == ids and {r["doc_id"]: r["label"] for r in whole}[ids[1]] == 1


def test_keep_good_keeps_columns(spark):
    docs, labels = labelled(spark)
    model = zstd_quality.fit(docs, labels)
    kept = zstd_quality.keep_good(with_hard(spark, docs), model)
    assert kept.columns == ["doc_id", "text", "score", "label", "lang"] and 280 <= kept.count() <= 320


def test_folding_and_exceptions():
    lexicon = toxicity.Lexicon((("idiot", 3.0), (toxicity.fold("trash"), 1.5)), (("moron", 2.0),))
    hits = lambda t: [(h[0], h[2]) for h in toxicity.Matcher(lexicon).hits(toxicity.fold(t))]
    for said in ("idiot", "IDIOT!", "1d10t", "ｉｄｉｏｔ", "ìdíöt", "іdіоt", "id​iot", "i­diot", "𝐢𝐝𝐢𝐨𝐭", "id|ot"):
        assert hits(said) == [(0, 3.0)], said
    assert hits("idiotic") == [] and hits("anidiot") == [] and hits("moronic") == [(0, 2.0)] and hits("oxymoron") == []
    assert hits("the trash can is full") == [] and hits("you trash") == [(4, 1.5)] and hits("") == [] and hits("2021 100") == []


def test_copies_count_once_in_learning():
    clean = [(" ".join(f"c{i}x{k}" for k in range(30)), 0) for i in range(200)]
    copies = [("chanceword " + " ".join(f"t{k}" for k in range(60)), 1)] * 40
    assert "chanceword" not in dict(toxicity.learn_lexicon(clean + copies).words)
    real = [("nastyword " + " ".join(f"t{i}y{k}" for k in range(30)), 1) for i in range(40)]
    learned = toxicity.learn_lexicon(clean + real)
    assert any("nastyword".startswith(e) for e, _ in learned.words + learned.stems if e not in toxicity.SEED_WORDS)


# --- media ------------------------------------------------------------------


def test_flac_round_trip_and_seek():
    r = random.Random(2)
    payloads = [flac.payload_of(t) for t in ("", None, "x", "é" * 5000, "a" * 64, "ab" * 40_000, "".join(map(chr, r.choices(range(32, 1000), k=20_000))))]
    payloads.append(bytes(r.randrange(256) for _ in range(64 * 200)))
    media = flac.encode(payloads)
    for data, blocks, stored in zip(payloads, flac.decode(media), media, strict=True):
        assert (np.concatenate([b for _, b in blocks]).view(np.uint8) ^ 0x80).tobytes() == data
        stream, at = flac.read_metadata(stored), 0
        ends = [*[stream.audio + p[1] for p in stream.points[1:]], len(stored)]
        for (sample, offset, n), end, (first, block) in zip(stream.points, ends, blocks, strict=True):
            size, number, head = flac._read_header(stored, stream.audio + offset)
            assert sample == first == at and size == n == len(block) and number * flac.BLOCK == sample
            one = flac.decode_frame(stored[stream.audio + offset : end], head, size)  # bit by bit
            assert np.array_equal(one, block)
            at += size
    assert len(flac.payload_of("")) == 64 and len(flac.payload_of("a" * 64)) == 64 and len(flac.payload_of("a" * 65)) == 128


def test_seeking_reads_one_block():
    """Any sample is found through the seek table; other frames may be broken, its own may not."""
    payload = flac.payload_of("seekable text " * 2000)
    (stored,) = flac.encode([payload])
    whole = np.frombuffer(payload, np.uint8)
    for sample in (0, 1, flac.BLOCK - 1, flac.BLOCK, 3 * flac.BLOCK + 5, len(payload) - 1):
        first, block = flac.read_block(stored, sample)
        assert first <= sample < first + len(block) and ((block.view(np.uint8) ^ 0x80) == whole[first : first + len(block)]).all()
    stream = flac.read_metadata(stored)
    broken = bytearray(stored)
    broken[stream.audio + stream.points[2][1] + 40] ^= 4
    assert flac.read_block(bytes(broken), 0)[0] == 0
    with pytest.raises(ValueError, match="checksum"):
        flac.read_block(bytes(broken), 2 * flac.BLOCK)
    with pytest.raises(ValueError, match="no such sample"):
        flac.read_block(stored, len(payload))


def test_flac_checksums_catch_damage():
    stored = bytearray(flac.encode([flac.payload_of("some text " * 900)])[0])
    stream = flac.read_metadata(bytes(stored))
    for where, message in ((stream.audio + 2, "header|disagree|frame"), (stream.audio + 300, "frame checksum"), (26, "MD5")):
        broken = stored.copy()
        broken[where] ^= 1
        with pytest.raises(ValueError, match=message):
            flac.decode([bytes(broken)])
    with pytest.raises(ValueError):
        flac.decode([b"no stream"])


def test_flac_reads_other_subframes():
    """Constant, verbatim and escape-coded frames, which the writer does not make."""
    def stream(subframe_bits, samples):
        head = flac._frame_header(0, len(samples))
        n = len(subframe_bits)
        body = int(subframe_bits.ljust(-(-n // 8) * 8, "0"), 2).to_bytes(-(-n // 8), "big")
        frame = head + body
        frame += struct.pack(">H", int(flac.crc16_many(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]))[0]))
        signed = np.array(samples, np.int8).tobytes()
        info = struct.pack(">HH", 4096, 4096) + bytes(6) + (8000 << 44 | 7 << 36 | len(samples)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        table = struct.pack(">QQH", 0, 0, len(samples))
        return b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + frame

    byte = lambda v: format(v & 255, "08b")
    values = [(7 * i) % 100 - 50 for i in range(64)]
    escape = "00010000" + "00" + "0000" + "1111" + "01000" + "".join(map(byte, values))
    for bits, samples in (("00000000" + byte(-5), [-5] * 64), ("00000010" + "".join(map(byte, values)), values), (escape, values)):
        assert flac.decode([stream(bits, samples)])[0][0][1].tolist() == samples


def test_media_query_and_blocks(spark, sf_dir):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert none.select(flac.read_column(flac.encode_column(F.col("text")))).count() == 0 and flac.pcm_blocks(none.select("doc_id", F.lit(b"").alias("media"))).count() == 0
    docs = spark.createDataFrame(HARD, "doc_id long, text string")
    stored = docs.select("doc_id", flac.encode_column(F.col("text")).alias("media"))
    blocks = flac.pcm_blocks(stored).toPandas()
    for d, t in {900: None, 901: "", 902: "x" * 300_000}.items():
        own = blocks[blocks.doc_id == d].drop_duplicates("sample_offset").sort_values("sample_offset")
        assert (np.frombuffer(b"".join(own.pcm), np.uint8) ^ 0x80).tobytes() == flac.payload_of(t)
    for r in op3_flac(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id").collect():
        payload = flac.payload_of(r["text"])
        assert r["seek_offsets"] == ",".join(map(str, range(0, len(payload), flac.BLOCK))) and r["blocks"] == -(-len(payload) // flac.BLOCK)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(r["text"].encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


# --- markup -----------------------------------------------------------------

PAGES = [
    (None, ""), ("", ""), ("plain", "plain"), ("a<br>b", "a\nb"), ("<p>one<p>two <b>bo</b>ld", "one\n\ntwo bold"),
    ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>end", "* a\n* b\n  3. x\n  4. y\n\nend"),
    ("<table><tr><th>N<th>Value<tr><td>alpha<td>1<tr><td colspan=2>wide</table>", "N     | Value\n------+------\nalpha | 1\nwide"),
    ("<table><caption>C</caption><td>日本<td>x<tr><td>abcde<td>y</table>", "C\n日本  | x\nabcde | y"),
    ("<pre>\n a\n  b</pre>c", " a\n  b\n\nc"), ("<div>a</div><div>b</div>", "a\nb"), ("a &lt; b &amp;amp; c < d", "a < b &amp; c < d"),
    ("<p hidden>x</p><p style='display:none'>y</p><span aria-hidden=true>z</span>k", "k"), ("<script>var a='<p>x</p>'</script><style>p{}</style>t", "t"),
    ("<title>no</title><body>yes</body>", "yes"), ("<dl><dt>T<dd>D</dl>", "T\n    D"), ("<blockquote>q<p>r</blockquote>s", "    q\n\n    r\n\ns"),
    ("<table><tr><td>o<table><tr><td>i<td>j</table><td>k</table>", "o     | k\n      |\ni | j |"), ("<!-- c --><p>a<!-- unclosed", "a"), ("a<p", "a"), ("<td>x</td>", "x"),
    ("<select><option>a<option>b</select>", "a\nb"), ("</p>x", "x"), ("<img alt='pic'> <input type=hidden value=h><input type=submit value=Go>", "pic Go"),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_layout(page, text):
    assert html_layout.extract(page) == text


def test_layout_of_stray_text_formulas_drawings_and_row_spans():
    assert html_layout.extract("<table><tr>stray<td>x</table>").split() == ["stray", "x"]
    assert html_layout.extract("<table><tbody>loose<tr><td>x</table>").split() == ["loose", "x"]
    assert html_layout.extract("<p>a <math><mfrac><mn>1</mn><mn>2</mn></mfrac><annotation>tex</annotation></math> b") == "a 1 2 b"
    assert html_layout.extract("<svg><title>t</title><defs><text>no</text></defs><g><path d='M0'/><text>Label</text></g></svg>") == "Label"
    page = "<table><tr><td rowspan=2>a<td>b<tr><td>c</table>"
    assert html_layout.extract(page) == "a | b\n  | c"
    assert html_layout.extract("<table><tbody><tr><td rowspan=9>a<td>b<tbody><tr><td>c<td>d</table>") == "a | b\nc | d"


SEEN = [
    ('<span style="visibility:hidden">v<b style="visibility:visible">w</b>z</span>q', "wq"), ("a<p style='backface-visibility:hidden'>shown</p>", "a\n\nshown"),
    ("<table><tr style='visibility:hidden'><td>a<td style='visibility: visible'>b<td>c<tr><td>d<td>e</table>", "  | b |\nd | e"),
    ("<ul style='visibility:hidden'><li>a<li style='visibility:visible'>b</ul>", "* b"), ("<svg><g style='visibility:hidden'><text>no</text></g><text>yes</text></svg>", "yes"),
    ("<div style='display:none'><b style='visibility:visible'>no</b></div>k", "k"), ("<p style='visibility:hidden;visibility:visible'>last says", "last says"),
    ("<img alt=x style='visibility:hidden'><hr style='visibility:hidden'>k", "k"), ("<ol start=3><li>a<li value=7>b<li>c</ol>", "3. a\n7. b\n8. c"),
    ("<ol reversed><li>a<li>b<li>c</ol>", "3. a\n2. b\n1. c"), ("<ol type=a><li>a<li value=28>b</ol>", "a. a\nab. b"),
    ("<ol type=I><li value=1994>x<li value=4000>y<li type=i value=9>z</ol>", "MCMXCIV. x\n4000. y\nix. z"), ("<ol start=-1><li>a<li>b</ol>", "-1. a\n0. b"),
    ("a<img alt=alt>b<textarea>t</textarea>c<button>God</button>d<button>b1</button><button>b2</button>", "a alt b t c God d b1 b2"),
]


@pytest.mark.parametrize(("page", "text"), SEEN)
def test_visibility_numbers_and_boxes(page, text):
    assert html_layout.extract(page) == text


def _tree(r, depth):
    """A random tree: (tag, visibility or None, children) and texts."""
    tags = ["div", "p", "span", "b", "button", "ul", "li", "br", "img", "blockquote", "em"]
    made = []
    for _ in range(r.randrange(1, 4)):
        tag = r.choice(tags)
        if depth == 0 or r.random() < 0.4:
            made.append(r.choice(["one", " two ", "three four", "  ", "x\n y", "z"]))
        elif tag in ("br", "img"):
            made.append((tag, None, []))
        else:
            made.append((tag, r.choice([None, None, None, "hidden", "visible", "none"]), _tree(r, depth - 1)))
    return made


def _markup(nodes):
    out = []
    for n in nodes:
        if isinstance(n, str):
            out.append(n)
            continue
        tag, say, inner = n
        style = f' style="{"display: none" if say == "none" else "visibility:" + say}"' if say else ""
        out.append({"br": "<br>", "img": "<img alt=pic>"}.get(tag) or f"<{tag}{style}>{_markup(inner)}</{tag}>")
    return "".join(out)


def _plain_layout(nodes):
    """The layout by recursion: lines are cut from runs of text between ends of blocks."""
    done, run, state = [], [], {"margin": 0, "marker": "", "indent": 0}

    def end():
        line = re.sub(r"[ \t\n]+", " ", "".join(run)).strip(" ")
        run.clear()
        if line:
            done.extend([""] * (state["margin"] if done else 0))
            state["margin"] = 0
            done.append(" " * (state["indent"] - len(state["marker"])) + state["marker"] + line)
            state["marker"] = ""

    def space(n):
        end()
        state["margin"] = max(state["margin"], n)

    def walk(nodes, seen, lists):
        for n in nodes:
            if isinstance(n, str):
                run.append(n if seen else "")
                continue
            tag, say, inner = n
            if say == "none":
                continue
            shown = seen if say is None else say == "visible"
            if tag == "br":
                if run and "".join(run).strip():
                    end()
                elif done:
                    run.clear()
                    done.extend([""] * state["margin"] + [(" " * (state["indent"] - len(state["marker"])) + state["marker"]).rstrip()])
                    state["margin"], state["marker"] = 0, ""
            elif tag == "img":
                run.append(" pic " if shown else "")
            elif tag == "button":
                run.append(" " if shown else "")
                walk(inner, shown, lists)
                run.append(" " if shown else "")
            elif tag == "li":
                end()
                state["indent"] += 2
                state["marker"] = "* " if shown else ""
                walk(inner, shown, lists)
                end()
                state["marker"] = ""
                state["indent"] -= 2
            elif tag in ("div", "p", "ul", "blockquote"):
                n_lines = {"div": 0, "ul": 0 if lists else 1}.get(tag, 1)
                space(n_lines)
                state["indent"] += 4 * (tag == "blockquote")
                walk(inner, shown, lists + (tag == "ul"))
                space(n_lines)
                state["indent"] -= 4 * (tag == "blockquote")
            else:
                walk(inner, shown, lists)

    walk(nodes, True, 0)
    end()
    return "\n".join(line.rstrip() for line in done).strip("\n")


def test_layout_equals_recursion_on_random_trees():
    """Trees of blocks, lists, boxes and inline elements, seen and hidden; such as parse to themselves."""
    r, tried = random.Random(12), 0
    while tried < 1500:
        nodes = _tree(r, 4)
        page = _markup(nodes)
        # Nesting that HTML itself takes apart has no tree of its own.
        if re.search(r"<p[ >](?:(?!</p>).)*<(?:div|p|ul|blockquote)[ >]|<li[ >](?:(?!</li>).)*<li[ >]|<button[ >](?:(?!</button>).)*<(?:button|div|p|ul|li|blockquote)[ >]", page, re.S):
            continue
        tried += 1
        assert html_layout.extract(page) == _plain_layout(nodes), page


def test_layout_of_deep_and_long_pages():
    assert html_layout.extract("<div><p>" * 30_000 + "deep") == "deep"
    assert html_layout.extract("<b>" * 50_000 + "x") == "x"
    assert html_layout.extract("<ul><li>x" * 300).count("x") == 300
    assert html_layout.extract("<p>line" * 20_000).count("line") == 20_000


def _timed(page):
    import time

    began = time.time()
    return html_layout.extract(page), time.time() - began


def test_layout_is_linear_in_hard_pages():
    """Deep lists, one huge cell, open quotes, spans and nests: bounded time and output, no text lost."""
    text, seconds = _timed("<ul><li>x" * 4000)
    assert text.count("x") == 4000 and len(text) < 300_000 and seconds < 10
    text, seconds = _timed("<table><tr><td>" + "y" * 1_000_000 + "<td>b" + "<tr><td>a<td>b" * 10_000)
    assert text.count("y") == 1_000_000 and text.count("a | b") == 10_000 and len(text) < 1_200_000 and seconds < 30
    assert _timed("<a " * 200_000 + '"')[1] < 20 and _timed('<a x="' * 100_000 + "y")[1] < 20
    assert _timed("<p><table><td>" + "<div>" * 50_000 + "x")[1] < 20
    assert _timed("<table><tr><td>" * 5000 + "x")[0] == "x"
    text, seconds = _timed("<table>" + "<tr>" + "<td>a" * 1000 + "<tr><td colspan=1000>x<td>y" * 5000)
    assert text.count("x | y") == 5000 and len(text) < 1_000_000 and seconds < 30
    text, seconds = _timed("<table><tr>" + "".join(f"<td rowspan={k + 2}>a" for k in range(1000)) + "<tr><td>x" * 5000)
    assert text.count("x") == 5000 and text.count("a") == 1000 and len(text) < 1_000_000 and seconds < 30


def test_layout_of_wide_spans():
    row = "<tr>" + "".join(f"<td>c{k}" for k in range(60)) + "<td>end"
    text = html_layout.extract("<table>" + row + "<tr><td colspan=60>w<td>last</table>")
    first, second = text.split("\n")
    assert first.index("end") == second.index("last")


def test_layout_of_tables_of_rows(spark):
    pages = spark.createDataFrame([(1, "<p>a"), (1, "<p>a"), (2, None), (3, "")], "page_id long, html string").withColumns({"text": F.lit("z"), "url": F.lit("u")})
    rows = html_layout.render_pages(pages)
    assert rows.columns == ["page_id", "text"] and sorted((r[0], r[1] or "") for r in rows.collect()) == [(1, "a"), (1, "a"), (2, ""), (3, "")]
    assert html_layout.render_pages(pages.limit(0)).count() == 0


def test_all_visible_words_come_out_once(spark, sf_dir):
    """Against a plain strip of tags, on the driver's pages: same words in the same order."""
    drop = re.compile(r"(?is)<head.*?</head>|<script.*?</script>|<style.*?</style>|<!--.*?-->")
    import html as entities

    rows = html_layout.render_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).join(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id").collect()
    for r in rows:
        plain = entities.unescape(re.sub(r"<[^>]+>", " ", drop.sub(" ", r["html"]))).split()
        assert [w for w in r["text"].split() if w != "*"] == [w for w in plain if w != "*"]


# --- licences ---------------------------------------------------------------


#: Texts and the labels that the rules give them.
NOTICES = [
    ("Licensed under the Apache License, Version 2.0", {"apache-2.0", "unspecified", "apache"}),
    ("SPDX-License-Identifier: LGPL-2.1-or-later", {"lgpl-2.1"}),
    ("under CC BY-NC-SA 4.0", {"cc-by-nc-sa-4.0"}),
    ("GNU\n * Lesser General\n * Public License", {"lgpl"}),
    ("the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", {"gpl-2.0"}),
    ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", {"gpl-3.0"}),
    ("All advertising materials mentioning features or use of this software must display the following acknowledgement", {"bsd-4-clause"}),
    ("Neither the name of Acme nor the names of its contributors may be used to endorse or promote products derived from this software", {"bsd-3-clause"}),
    ("See https://www.mozilla.org/MPL/2.0/", {"mpl-2.0"}),
    ("The Software shall be used for Good, not Evil.", {"json"}),
    ("Eclipse Public License - v 1.0", {"epl-1.0"}),
    ("mit der license", set()),
    ("", set()),
]


def test_licence_rules_and_suppression():
    scanner = license_rules.Scanner()
    assert len(license_rules.rules()) >= 250 and len({r.pattern for r in license_rules.rules()}) == len(license_rules.rules())
    for text, labels in NOTICES:
        assert {d.rule.label for d in scanner.scan(text)} == labels, text
    rule = lambda name, p: license_rules.Rule(name, name, p, 0.5, "k", "k")
    d = license_rules.Detection
    a, b, c, e = d(0, 10, rule("a", 1)), d(2, 5, rule("b", 9)), d(2, 5, rule("c", 9)), d(4, 12, rule("e", 5))
    assert license_rules.resolve([a, b, c, e]) == [a, b, e] and license_rules.resolve([]) == []


def test_prefilter_loses_no_match():
    """All patterns over whole texts find what the keyword stretches find."""
    r = random.Random(12)
    scanner = license_rules.Scanner()
    filler = " ".join(words(200, 5)) if "words" in globals() else "word " * 200
    texts = [t for t, _ in NOTICES] + [filler + t + filler + u for t, _ in NOTICES for u, _ in r.sample(NOTICES, 3)]
    for text in texts:
        normal = scanner._normal(text)
        every = [license_rules.Detection(m.start(), m.end(), rule) for rule in license_rules.rules() for m in re.finditer(rule.pattern, normal, re.ASCII)]
        assert scanner.scan(text) == license_rules.resolve(every)
    for rule in license_rules.rules():
        assert rule.keyword == rule.keyword.lower() and 0 < rule.confidence <= 1


def test_resolve_equals_all_pairs():
    r = random.Random(9)
    for _ in range(200):
        found = [license_rules.Detection(s, s + r.randrange(1, 9), license_rules.Rule(str(k), "l", r.randrange(3), 0.5, "k", "k")) for k, s in enumerate(r.choices(range(20), k=12))]
        taken = []
        for x in sorted(found, key=lambda x: (-x.rule.priority, x.start - x.end, x.start, x.rule.name)):
            if not any(t.start <= x.start and x.end <= t.end for t in taken):
                taken.append(x)
        assert license_rules.resolve(found) == sorted(taken, key=lambda x: (x.start, x.end))


def test_base_phrases_equal_brute_force(spark, sf_dir):
    texts = ["", None, "GNU General  PUBLIC-license apache license CC BY cc_by ccby MIT License mit", "é cc by É" * 3, "cc\x00by", "cc cc by by"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = [(r["text"], r) for r in license_rules.scan(docs).join(docs, "doc_id").collect()]
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows += [(r["text"], r) for r in op5_license_rules(spark, sf_dir).join(whole, "doc_id").collect()]
    for text, r in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        places = [(i, label) for phrase, label in license_rules.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        starts = [i for i, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(places), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_licences_of_hard_tables(spark):
    long_ = "word " * 300_000 + "licensed under the apache license, version 2.0 " + "word " * 300_000
    docs = spark.createDataFrame([(1, long_), (1, long_), (None, None), (2, "")], "doc_id long, text string").withColumns({c: F.lit("x") for c in ("r", "labels", "score", "n_words")})
    rows = license_rules.scan(docs).collect()
    assert [r["labels"] for r in rows if r["doc_id"] == 1] == ["apache,apache-2.0,unspecified"] * 2 and [r["n_words"] for r in rows if r["doc_id"] != 1] == [0, 0]
    assert license_rules.scan(docs.limit(0)).count() == 0


# --- chats ------------------------------------------------------------------


def test_chats_read_back(spark):
    nasty = ["", "plain", "<|im_end|>\n<|im_start|>assistant\nok", "\\", "<\\|", "<\\\\|x", "a\\<|b|>", "<|turn|>", "\n\n", "<\\n>", "é\U0001f600<"]
    rows = [(1, i, "assistant" if i % 3 else "user", t) for i, t in enumerate(nasty)]
    rows += [(2, 0, "user", None), (3, 1, "a\nb<|", "x"), (3, 0, None, "y"), (3, 1, "a\nb<|", "x"), (None, 5, "assistant", "n"), (4, None, "assistant", "late"), (4, 0, "assistant", "early")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"turns": F.lit(1), "formatted": F.lit("z")})
    made = chat_format.format_conversations(turns)
    found = chat_format.digests(made).collect()
    assert len(found) == len({r["conv_id"] for r in found})
    out = {r["conv_id"]: r for r in found}
    stored = {r["conv_id"]: r for r in made.collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    assert set(out) == set(by)
    for c, said in by.items():
        said.sort()
        assert out[c]["n_turns"] == len(said)
        assert out[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in said).encode()).hexdigest()
        loss = "".join(t for _, r, t in said if r == "assistant")
        assert out[c]["loss_chars"] == len(loss) and out[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        text = stored[c]["formatted"]
        assert out[c]["formatted_chars"] == len(text) and len(stored[c]["loss_mask"]) == sum(r == "assistant" for _, r, _ in said)
        blocks = sum(i == 0 or said[i - 1][1] != said[i][1] for i in range(len(said)))
        assert text.count("<|im_start|>") == text.count("<|im_end|>") == blocks
    assert chat_format.digests(chat_format.format_conversations(turns.limit(0))).count() == 0


def test_rows_without_conversation_are_each_their_own(spark):
    turns = spark.createDataFrame([(None, 0, "assistant", "a")] * 3 + [(None, 1, "user", "b")], "conv_id long, turn long, role string, text string")
    rows = chat_format.digests(chat_format.format_conversations(turns)).collect()
    assert sorted((r["conv_id"], r["n_turns"], r["loss_chars"]) for r in rows) == [(None, 1, 0)] + [(None, 1, 1)] * 3


def test_a_conversation_of_many_turns(spark):
    import time

    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i} é <|x") for i in range(20_000)]
    began = time.time()
    (made,) = chat_format.digests(chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    loss = "".join(t for _, _, role, t in rows if role == "assistant")
    assert made["n_turns"] == 20_000 and made["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and time.time() - began < 60


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 101])
def test_starts_are_sums_of_what_stands_before(spark, n):
    row = spark.createDataFrame([([k * 7 % 13 for k in range(n)],)], "lengths array<long>").select(chat_format.starts_of(F.col("lengths")).alias("s")).first()
    assert row["s"] == [sum(k * 7 % 13 for k in range(i)) for i in range(n)]


# --- classifiers against plain twins ----------------------------------------


def test_matcher_equals_a_naive_scan():
    r = random.Random(21)
    letters = "abc"
    for _ in range(300):
        word = lambda: "".join(r.choice(letters) for _ in range(r.randrange(1, 5)))  # noqa: E731, B023
        lexicon = toxicity.Lexicon(
            tuple({word(): 1.0 + r.random() for _ in range(4)}.items()), tuple({word(): 2.0 + r.random() for _ in range(3)}.items()), tuple({f"{word()} {word()}" for _ in range(3)})
        )
        text = " ".join(word() for _ in range(r.randrange(0, 25)))
        best, spared = {}, []
        for at in range(len(text)):
            if at and text[at - 1].isalnum():
                continue
            for kind, entries in (("word", lexicon.words), ("stem", lexicon.stems), ("exception", [(e, 0.0) for e in lexicon.exceptions])):
                for entry, weight in entries:
                    end = at + len(entry)
                    if text[at:end] != entry or (kind != "stem" and end < len(text) and text[end].isalnum()):
                        continue
                    if kind == "exception":
                        spared.append((at, end))
                    else:
                        best[at] = max(best.get(at, (0, 0.0)), (end, weight))
        want = [(a, end, w) for a, (end, w) in sorted(best.items()) if not any(x <= a and end <= y for x, y in spared)]
        assert toxicity.Matcher(lexicon).hits(text) == want


def test_difference_equals_plain_compression(spark):
    import zstandard

    docs, labels = labelled(spark, 120)
    model = zstd_quality.fit(docs, labels)
    texts = ["", "a", "plain good words " * 40, "BAD!! | WORSE!! | " * 300, "é" * 5000]
    measure = zstd_quality.Difference(model.dictionaries)
    for text in texts:
        data = text.encode()
        saved = 0
        for (_, block), (good, bad) in zip(zstd_quality.PAIRS, model.dictionaries, strict=True):
            sizes = []
            for content in (good, bad):
                made = zstandard.ZstdCompressor(level=zstd_quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=False, write_dict_id=False)
                sizes.append(sum(len(made.compress(data[i : i + block])) for i in range(0, len(data), block)))
            saved += sizes[1] - sizes[0]
        assert measure.of(text) == pytest.approx(saved / 3 / max(1, len(data)))
    lengths = np.full(50, 800.0)
    scores = model.score(np.linspace(-0.5, 0.5, 50), lengths)
    assert (np.diff(scores) >= 0).all() and scores[0] < zstd_quality.THRESHOLD < scores[-1]


def test_long_texts_are_sampled_by_a_stretch(spark):
    docs = spark.createDataFrame([(d, f"{d} " * 20_000) for d in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(d, 1, d % 2) for d in range(20)], LABELS)
    rows = common.label_sample(docs, labels, "toxic", (50, 50), 1000).collect()
    assert len(rows) == sum(zlib.crc32(str(d).encode()) % 5 > 0 for d in range(20)) and all(len(r["text"]) == 1000 for r in rows)

import json
import random
import re
from collections import Counter, defaultdict

import pytest

from ringweave.llm import copies
from ringweave.llm.copies import Trie, collapsed, copy_members
from ringweave.llm.leaks import leaked_items
from ringweave.llm import packing
from ringweave.llm.packing import pack, token_counts
from ringweave.llm.residue import bare_lines, has_open_slot, repeats, residue_documents, residue_verdicts, skeleton, verdict
from ringweave.llm.topn import top_items

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def test_top_items(spark):
    rng = random.Random(3)
    data = [(rng.choice("abc"), f"i{rng.randrange(40)}", rng.choice([None, 1.0, 2.0, 3.5, rng.random() * 5])) for _ in range(600)]
    data += [("hot", f"h{i:04}", float(i % 7)) for i in range(3000)] + [("few", "x", 1.0), ("few", "x", 1.0), ("none", "y", None), (None, "y", 1.0), ("few", None, 9.0), ("nan", "p", float("nan")), ("nan", "q", 1e300)]
    df = spark.createDataFrame([(*d, 1, "c") for d in data], "g string, i string, s double, x int, place string").repartition(7)
    got = sorted(tuple(r) for r in top_items(df, "g", "i", "s", 4).collect())
    best = defaultdict(dict)
    for g, i, s in data:
        if None not in (g, i, s):
            s = float("inf") if s != s else s
            best[g][i] = max(s, best[g].get(i, s))
    expected = sorted((g, k + 1, i) for g, items in best.items() for k, (i, _) in enumerate(sorted(items.items(), key=lambda x: (-x[1], x[0]))[:4]))
    assert got == expected
    assert top_items(df.filter("false"), "g", "i", "s").columns == ["g", "item_rank", "i"]


def same_records(rows):
    groups = defaultdict(set)
    for number, label, seq in rows:
        s = re.sub("[^A-Za-z]", "", seq or "").upper()
        if number is not None and s:
            groups[s, tuple(sorted(w.lower() for w in re.findall("[A-Za-z0-9]+", label or "")))].add(number)
    return {n: min(g) for g in groups.values() for n in g}


def record_rows():
    rng = random.Random(4)
    rows = [(i, rng.choice(["A b|c", "c, B a", "a;b", None, ""]), rng.choice(["acgt" * 30, "AC-GT " * 30, "acgt" * 30 + "a", "T" * 500 + rng.choice("AC") + "G" * 50])) for i in range(300)]
    rows += [(1000 + i, "x y", "ggtt\n" * 40) for i in range(400)]
    return rows + [(2000, "x", None), (2001, "x", ""), (2002, "x", "-*"), (None, "x", "acgt"), (2003, "é x", "acgt"), (2004, "x", "ACGT"), (2004, "x", "ACGT"), (2005, "x X", "acgt"), (2006, "x", "a" * 200_000)]


@pytest.mark.parametrize("room", [16_000_000, 4000, 300])
def test_copies(spark, room):
    rows = record_rows()
    df = spark.createDataFrame([(*r, "b", False) for r in rows], "n long, label string, seq string, bucket string, split boolean")
    got = [tuple(r) for r in copy_members(df, "n", "label", "seq", bucket_bytes=room).collect()]
    assert len(got) == len({n for n, _ in got})
    assert dict(got) == same_records(rows)


def test_more_buckets_to_split_than_are_sent(spark, monkeypatch):
    monkeypatch.setattr(copies, "MOST_SENT", 0)
    rows = record_rows()
    df = spark.createDataFrame(rows, "n long, label string, seq string")
    assert dict(tuple(r) for r in copy_members(df, "n", "label", "seq", bucket_bytes=300).collect()) == same_records(rows)


def test_collapsed_and_empty(spark):
    rows = record_rows()
    df = spark.createDataFrame(rows, "n long, label string, seq string")
    assert {r.ref_no: r.n_copies for r in collapsed(df, "n", "label", "seq").collect()} == Counter(same_records(rows).values())
    assert copy_members(df.filter("false"), "n", "label", "seq").collect() == []


def test_trie_splits_shared_paths():
    trie = Trie()
    values = ["", "a", "a" * 64, "a" * 65, "a" * 64 + "b", "a" * 200, "a" * 199 + "b"]
    for n, v in enumerate(values * 2):
        trie.add(v, n)
    assert {t[0]: (t[1], t[2]) for t in trie.terminals()} == {v: (i, {i, i + len(values)}) for i, v in enumerate(values)}


def text_rows():
    rng = random.Random(5)
    words = "graph node the of value return if def class 12 list".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 20, 60, 300])))) for i in range(200)]
    return rows + [(900, None), (901, ""), (902, "word " * 700), (903, " ".join(f"x{i}" for i in range(900))), (904, "<|endoftext|>"), (None, "x"), (905, "é🙂" * 40)]


@pytest.mark.parametrize("runs", [256, 5])
def test_packing(spark, monkeypatch, runs):
    monkeypatch.setattr(packing, "SWEEP_RUNS", runs)
    rows = text_rows()
    df = spark.createDataFrame([(*r, "a", 3) for r in rows], "d long, t string, piece string, size int")
    sizes = {r.doc: r.tokens for r in token_counts(df, "d", "t", VOCABULARY).collect()}
    assert set(sizes) == {d for d, t in rows if d is not None and t}
    got = pack(df, "d", "t", capacity=128, vocabulary=VOCABULARY).collect()
    used, pieces = Counter(), defaultdict(list)
    for r in got:
        used[r.bin] += r.n_tokens
        pieces[r.doc_id].append((r.piece, r.token_from, r.n_tokens))
    assert max(used.values()) <= 128 and sorted(used) == list(range(len(used)))
    for d, n in sizes.items():
        at = 0
        for k, (piece, start, size) in enumerate(sorted(pieces[d])):
            assert (piece, start) == (k, at) and 0 < size <= 128
            at += size
        assert at == n and len(pieces[d]) == -(-n // 128)
    least = -(-sum(sizes.values()) // 128)
    assert len(used) <= 1.03 * least + 1
    # No worse than placing one text after another, the largest first, where it fits best.
    rooms = []
    for size in sorted((s for p in pieces.values() for _, _, s in p), reverse=True):
        fit = min((r for r in rooms if r >= size), default=None)
        if fit is None:
            rooms.append(128 - size)
        else:
            rooms[rooms.index(fit)] = fit - size
    assert len(used) <= len(rooms) + 2
    assert pack(df.filter("false"), "d", "t", vocabulary=VOCABULARY).collect() == []


def leaks_by_words(items, docs, n):
    words = lambda t: re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    owners = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(len(w) - n + 1):
            owners[tuple(w[k : k + n])].add(i)
    return {(i, d) for d, t in docs if d is not None for w in [words(t)] for k in range(len(w) - n + 1) for i in owners.get(tuple(w[k : k + n]), ()) if i is not None}


@pytest.mark.parametrize("digits", [27, 8])  # with 8, nearly every window passes the filter
def test_leaks(spark, digits):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(300)] + ["the", "a", "K"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 90)))) for i in range(30)] + [(30, None), (31, ""), (None, "a " * 30), (32, "the " * 25)]
    docs = []
    for d in range(80):
        parts = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 300))]
        if d % 3:
            source = (items[rng.randrange(30)][1] or "").split()
            at = rng.randrange(max(1, len(source) - 18))
            parts[len(parts) // 2 : len(parts) // 2] = source[at : at + rng.choice([19, 20, 21, 40])]
        docs.append((d, rng.choice([" ", "\n\t", "-", " / ", "é"]).join(parts).upper() if d % 2 else " ".join(parts)))
    docs += [(200, None), (201, ""), (None, items[0][1]), (202, items[32 - 1][1]), (203, "the " * 40), (204, "x" * 3_000_000 + " " + items[1][1]), (205, "K " * 40)]
    d = spark.createDataFrame([(*r, 1, "w") for r in docs], "id long, text string, band int, words string")
    i = spark.createDataFrame([(*r, "z") for r in items], "id long, text string, doc_id string")
    got = [tuple(r) for r in leaked_items(i, "id", "text", d, "id", "text", filter_digits=digits).collect()]
    assert len(got) == len(set(got))
    assert set(got) == leaks_by_words(items, docs, 20)


RESIDUE = [
    ("a.py", "def f(x):\n    return x\n404: Not Found\n", "error"), ("a.json", '{"message":"Service unavailable","code":503,"request":"a05a15f5a6"}', "error"),
    ("b.c", "<html>\r\n<head><title>503 Service unavailable</title></head>\r\n<body>x</body></html>", "error"), ("c.js", "Seite nicht gefunden", "error"),
    ("c.ts", "﻿SORRY, THIS MIRROR IS BEING SERVICED. COME BACK IN A FEW MINUTES.", "error"), ("d.go", "JavaScript is required to show this page. Enable it and reload.", "notice"),
    ("e.rs", '<!doctype html><html><body><noscript>Please turn on JavaScript to view this file.</noscript><div id="root"></div></body></html>', "notice"),
    ("README.md", "# Tool\n\nLorem ipsum dolor sit amet consectetur adipiscing elit sed do.\n", "filler"), ("doc.txt", "Delete this file once you have written your own.", "filler"),
    ("n.md", "Text goes here. Text goes here. Text goes here. Text goes here.", "filler"), ("package.json", '{\n  "name": "{{ project_name }}",\n  "main": "x.js"\n}', "slot"),
    ("LICENSE", "Copyright [yyyy] [name of holder]\n\nUse it.", "slot"), ("m.py", "# Author: <your email here>\nx = 1\n", "slot"), ("t.toml", 'name = "%%package_name%%"\n', "slot"),
]
CONTENT = [
    ("a.py", "raise LookupError('404: not found: %s' % key)\nretry()  # Service unavailable\n"), ("i18n.json", '{\n  "a": "Please turn on JavaScript to view this file.",\n  "b": "Page not found"\n}'),
    ("x.test.js", 'expect(view.text()).toContain("404 Not Found");'), ("p.html", "<!DOCTYPE html>\n<html><body>\n<noscript>Some charts need JavaScript; the tables below work without it.</noscript>\n<p>Data</p>\n</body></html>"),
    ("ci.yml", "jobs:\n  env:\n    TOKEN: ${{ secrets.NAME }}\n"), ("page.html.tmpl", "<h1>{{ title }}</h1>"), ("f.py", "FILLER = ['lorem', 'ipsum', 'dolor', 'sit', 'amet']\n"),
    ("g.py", "x = f'{title}-{{name}}'\n"), ("s.sh", 'cat > "$OUT" <<END\nname=${NAME}\nauthor=$AUTHOR\nEND\n'), ("h.md", "# Errors\n\nWhen the store answers 503 Service unavailable, callers wait.\nA `{{ title }}` in a template is filled.\n"),
    ("k.html", "<head><title>Report</title></head>"), (None, "The page that cannot be cached is put on the queue."), ("e.md", ""), ("n.md", None),
]


def test_residue(spark):
    rows = [(i, t, p, "x") for i, (p, t, _) in enumerate(RESIDUE)] + [(100 + i, t, p, "x") for i, (p, t) in enumerate(CONTENT)] + [(None, "404: Not Found", "a", "x"), (500, "word " * 100_000 + "\n404: Not Found", "a.txt", "x")]
    df = spark.createDataFrame(rows, "d long, t string, p string, line string")
    got = {(r.doc_id, r.verdict) for r in residue_verdicts(df, "d", "t", "p").collect()}
    assert {i: v for i, v in got if i < 500} == {i: v for i, (_, _, v) in enumerate(RESIDUE)}
    assert {(i, v) for i, v in got if i == 500 and v == "error"} == {(500, "error")}
    assert {r.doc_id for r in residue_documents(df, "d", "t", "p").collect()} == {i for i, _ in got}
    assert residue_documents(df.filter("false"), "d", "t", "p").collect() == []


def test_templates_agree_with_lines(spark):
    rng = random.Random(7)
    lines = [f"request {rng.randrange(10**6)} for item{i} was served in {i} ms" for i in range(300)] + [f"{rng.choice([404, 403])}: Not Found" for _ in range(20)] + [f"to see this {w} please turn on scripts" for w in "page file blob path".split()]
    rng.shuffle(lines)
    df = spark.createDataFrame(list(enumerate(lines)), "d long, t string")
    got = {r.doc_id for r in residue_verdicts(df, "d", "t").collect()}
    assert got == {i for i, t in enumerate(lines) if any(verdict(x) for x, _ in bare_lines(t)) or has_open_slot(t, None)}


def test_residue_reads_whole_texts(spark):
    menu = "".join(f"<li><a href='/{i}'>Part {w}</a></li>" for i, w in enumerate("one two three four five six seven eight nine ten".split()))
    words = " ".join(f"stone{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400))
    prose = "The walls of the old town were built by many hands over the years. " * 3
    latin = "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor."
    found = [
        (f"{words}. {latin}", "filler"), (f"{prose}The requested page could not be found. {words}", "error"), (f"<html><title>404 Not Found</title><ul>{menu}</ul></html>", "error"),
        ("# Tool\n" + "A line of the manual\n" * 60 + "Copyright (c) Your Name\n", "slot"),
    ]
    clean = [f"{words}. {words}", f"<html><ul>{menu}</ul><noscript>Please enable JavaScript.</noscript></html>", f"{prose}{words}"]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(found)] + [(100 + i, t) for i, t in enumerate(clean)], "d long, t string")
    assert {(r.doc_id, r.verdict) for r in residue_verdicts(df, "d", "t").collect()} == {(i, v) for i, (_, v) in enumerate(found)}


def test_skeletons_keep_the_verdicts_of_their_lines():
    rng = random.Random(8)
    spoken = "the this page file 404 <*> not found, is what returns please enable javascript: error: too many requests lorem ipsum dolor sit amet text goes here. without it some charts need oops! replace timed out".split()
    free = [f"{a}{b}{c}" for a in ("brick", "gravel", "lumber") for b in ("walls", "yards", "halls") for c in ("", ",", ".", "xyz")]
    lines = sorted({" ".join(rng.choice(free if rng.random() < 0.4 else spoken) for _ in range(rng.choice([3, 4, 6, 9, 12, 50, 90]))) for _ in range(4000)})
    lines += ["<*> not found is what it returns", "<*> not found in what it returns", "<*> not found at brickwalls now", "<*> not found at lumberyard now"]
    lines += [f"the page {w} could not be found" for w in free] + [f"to see {w} please turn on scripts" for w in free]
    lines += ["lorem ipsum dolor sit amet brickwalls", "text goes here. " * 3 + "brickyards", "brickwalls " * 11 + "gravel", "brickwalls " * 4 + "gravelyards lumberhalls " * 4]
    lines = [" ".join(x.split()) for x in lines]
    got = {line: verdict(skeleton(line), repeats(line)) for line in lines}
    assert got == {line: verdict(line) for line in lines} and {"error", "notice", "filler", None} == set(got.values())
    assert len({skeleton(f"the page {w} could not be found") for w in free if w.isalpha()}) == 1


def test_templates_of_lone_sentences_are_messages_wherever_they_stand(spark):
    """What no lexicon knows: a sentence that source files consist of, with words that differ, is a message inside others too."""
    place = lambda w: f"Our quarry has {w} nothing under that label."
    rows = [("a.py", place("brickwalls")), ("b.js", "\n" + place("gravelyards") + "\n"), ("c.rs", place("lumberhalls")), ("d.go", "package x\n\nfunc f() {\n}\n" + place("gravelwalls") + "\n")]
    rows += [("e.md", place("lumberyards") + "\nMore of the text."), ("f.txt", "Sound stone lasts."), ("g.py", "Gravel is heavy here now."), *((f"h{i}.md", f"# Stone\n\nGravel is {w} here now.\nIt is.") for i, w in enumerate(("light", "dusty", "heavy")))]
    df = spark.createDataFrame([(i, t, p) for i, (p, t) in enumerate(rows)], "d long, t string, p string")
    assert verdict(skeleton(bare_lines(rows[0][1])[0][0])) is None
    assert {r.doc_id for r in residue_documents(df, "d", "t", "p").collect()} == {0, 1, 2, 3, 4}


MORE = [
    ("Access to this resource has been restricted by the administrator.", "error"), ("An unexpected exception occurred while processing your request.", "error"),
    ("You do not have permission to view this directory.", "error"), ("Your connection has expired. Please sign in again.", "error"),
    ("Please wait while we verify your browser.", "notice"), ("Complete the security check to continue.", "notice"), ("Access is denied when the token has expired.", None),
    ("An error occurred if the callback is called twice.", None), ("The walls of the old town were built by hand.", None),
]


def test_further_wordings():
    assert [(t, next((v for x, _ in bare_lines(t) if (v := verdict(skeleton(x), repeats(x)))), None)) for t, _ in MORE] == MORE


def test_marks_around_any_name_where_a_value_belongs():
    found = [("Phone: {{ phone }}", "a.md"), ("Call us at {{ phone }} today.", "README"), ("Price: {{ price }}", "a.txt"), ("Dear {{ customer_name }},\nthanks", "l.txt"), ("Date: {{DATE}}", "a.md"), ("Dear [RECIPIENT],", "a.md"), ('{\n "phone": "{{ phone }}"\n}', "a.json")]
    clean = [("x = f'{a}-{{pool}}'", "a.md"), ("Usage: tool [OPTIONS] FILE", "a.md"), ("Use `{{ phone }}` for it.", "a.md"), ("```\nphone: {{ phone }}\n```", "a.md"), ("port: {{ port }}", "a.yml"), ("{% for x in y %}\nport: {{ port }}\n", "a.md"), ("Phone: {{ phone }}", "a.md.j2")]
    assert [has_open_slot(*x) for x in found] == [True] * len(found) and [has_open_slot(*x) for x in clean] == [False] * len(clean)


def test_no_part_of_a_text_is_skipped():
    said = lambda t: {verdict(skeleton(x), repeats(x)) for x, _ in bare_lines(t)} - {None}
    assert said("```\nx\n" + "The page you asked for is gone.\n") == {"error"}  # a fence that nothing closes
    assert said("```\nThe page you asked for is gone.\n```\n") == set()
    assert said(f"<p class='{'x' * 2000}'>404 Not Found</p>") == {"error"}
    assert said('{"error": {"status": 410, "reason": "gone"}}') == {"error"} and said('{"status": 200, "reason": "gone"}') == set()


def test_json_bodies_say_errors_at_any_key_and_line(spark):
    found = [
        '{"status":404,"error":"Not Found","path":"/x"}', '{"code":503,"message":"Service unavailable"}', '{\n  "code": 404,\n  "message": "Not Found"\n}\n',
        '\ufeff{\r\n  "errors": [\r\n    {"status": "404", "detail": "Not Found"}\r\n  ]\r\n}', '{"ok": false, "error": {"code": 404, "message": "The requested file could not be found."}}',
    ]
    table = {f"key{i}": "Page not found" for i in range(30)} | {"error": "Page not found"}
    clean = ['{"a": "Page not found", "b": "Not Found"}', json.dumps(table), json.dumps(table, indent=2), '{"error": "Not Found"', '{"message": "All is well", "code": 200}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(found)] + [(100 + i, t) for i, t in enumerate(clean)], "d long, t string")
    assert {(r.doc_id, r.verdict) for r in residue_verdicts(df, "d", "t").collect()} == {(i, "error") for i in range(len(found))}

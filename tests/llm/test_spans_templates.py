import random

from panelyard.llm import spans, templates


def brute(texts, least_sentences=3, least_words=15):
    """Sentences removed from each text, by comparing runs as tuples of words."""
    first, found = {}, []
    for i, t in enumerate(texts):
        cuts = spans.sentences(t or "")
        words = [(t or "")[a:b].lower().split() for a, b in cuts]
        own = []
        for k in range(len(cuts)):
            stop = k + least_sentences
            while stop <= len(cuts) and sum(map(len, words[k:stop])) < least_words:
                stop += 1
            if stop <= len(cuts):
                key = tuple(w for x in words[k:stop] for w in x)
                own.append((k, stop, key))
                first.setdefault(key, (i, k))
        found.append((cuts, own))
    out = []
    for i, (cuts, own) in enumerate(found):
        gone = {j for k, stop, key in own if first[key] != (i, k) for j in range(k, stop)}
        out.append(("".join((texts[i] or "")[a:b] for n, (a, b) in enumerate(cuts) if n not in gone), len(gone)))
    return out


def test_spans_equal_brute_force(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(2, 5)))
    line = lambda: " ".join([word().capitalize(), *(word() for _ in range(r.randint(2, 9)))]) + r.choice(".!?")
    passage = [" ".join(line() for _ in range(9)) for _ in range(4)]
    texts = [None, "", "One.", passage[0], passage[0]]
    for _ in range(60):
        parts = [r.choice(passage) if r.random() < 0.4 else " ".join(line() for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 4))]
        texts.append(r.choice([" ", "\n", " of "]).join(parts))
    docs = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "doc_id long, text string, first string")
    got = {x.doc_id: x for x in spans.remove_repeated_spans(docs).collect()}
    want = brute(texts)
    assert [(got[i].text or "", got[i].sentences_removed) for i in range(len(texts))] == want
    assert got[0].text is None and got[4].text == "" and all(x.first == "kept" for x in got.values())
    assert spans.remove_repeated_spans(docs.limit(0)).count() == 0


def windows(texts, width=50):
    """Every ``width`` words that follow each other, as often as they occur."""
    for t in texts:
        w = (t or "").lower().split()
        yield from (tuple(w[k : k + width]) for k in range(len(w) - width + 1))


def test_no_fifty_words_stay_repeated(spark):
    r = random.Random(21)
    words = lambda n: [r.choice("bcdfgé") + "".join(r.choice("aeiou") + r.choice("lmnrst") for _ in range(r.randint(1, 4))) for _ in range(n)]
    one = " ".join(words(70)) + "."
    two = " ".join(words(45)) + ". " + " ".join(words(48)) + "!"
    around = "It is so. " + " ".join(words(60)) + ". It was so. " + " ".join(words(3))
    bare = words(51)
    texts = [one, one, two, two, " ".join(words(30)) + " " + one[:-1] + " " + " ".join(words(30)), " ".join(words(20)) + " " + around + " " + " ".join(words(20)), around]
    texts += [" ".join([*words(r.randint(0, 40)), *bare, *words(r.randint(0, 40))]) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert len(set(windows(texts))) < len(list(windows(texts)))
    got = {x.doc_id: x for x in spans.remove_repeated_spans(docs).collect()}
    left = [got[i].text for i in range(len(texts))]
    assert len(set(windows(left))) == len(list(windows(left)))
    assert left[0] == one and left[2] == two and left[5] == texts[5] and left[7] == texts[7]
    assert all(got[i].sentences_removed > 0 for i in (1, 3, 4, 6, *range(8, len(texts))))


ITEM = "Alice bought 12 kg of apples at the market for 30 dollars and then Bob sold 12 kg of pears to the same market for 45 dollars last week"


def test_templates_see_through_new_numbers_and_names(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, "short one"), (3, None)], "item_id long, text string")
    host = "some words before it in the text. "
    changed = ITEM.replace("12", "17").replace("30", "52").replace("Bob", "Zoe").replace("Alice", "Maya")
    clash = ITEM.replace("12 kg of pears", "99 kg of pears")
    texts = [host + ITEM + " and more.", host + changed + " and more.", host + clash, host * 20, "short one", None, "", ITEM[: len(ITEM) // 3]]
    docs = spark.createDataFrame([*enumerate(texts), (None, ITEM)], "doc_id long, text string")
    got = {(x.doc_id, x.item_id) for x in templates.leaks(docs, bench).collect()}
    assert got == {(0, 1), (1, 1), (4, 2)}
    assert templates.contaminated(docs.limit(0), bench).count() == 0
    assert templates.contaminated(docs, bench.limit(0)).count() == 0


def own_tokens(text):
    """(canonical token, value, is a slot) of each word, by the rules in the module's docstring."""
    out, start = [], True
    for word in (text or "").split():
        bare = word.strip(templates._EDGE) or word
        low = bare.lower()
        if low in templates._WORDS or templates._NUMBER.fullmatch(bare):
            kind = "<num>"
        elif low in templates.UNITS:
            kind = "<unit>"
        else:
            kind = "<name>" if bare[0].isupper() and not start and not (len(bare) > 1 and bare.isupper()) else None
        out.append((kind or low, low, kind is not None))
        start = bare != word and word.rstrip("\"'”’)")[-1:] in (".", "!", "?", ":")
    return out


def brute_leaks(doc, item, width=5, share=0.8):
    """Tokens of the item that consistent matches cover, or None below the share: every window against every other."""
    d, i = own_tokens(doc), own_tokens(item)
    w, groups = min(width, len(i)), {}
    for p in range(len(i) - w + 1) if i else ():
        for q in range(len(d) - w + 1):
            a, b = i[p : p + w], d[q : q + w]
            bare = w < width or all(x[2] for x in a)
            same = [x[1] for x in a] == [x[1] for x in b] if bare else [x[0] for x in a] == [x[0] for x in b]
            if same and (w < width or all(x[2] for x in a) == all(x[2] for x in b)):
                groups.setdefault(q - p, []).append((p, [] if w < width else [(x[1], y[1]) for x, y in zip(a, b, strict=True) if x[2]]))
    covered = set()
    for found in groups.values():
        pairs = {x for _, slots in found for x in slots}
        if len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs}):
            covered |= {t for p, _ in found for t in range(p, p + w)}
    return len(covered) if i and len(covered) >= share * len(i) else None


def test_templates_equal_brute_force(spark):
    r = random.Random(31)
    word = lambda: r.choice("a be cat dog eel fox gnu hen 3 4 5 kg Ann Bob ten.".split())
    phrase = " ".join(word() for _ in range(14))
    item = lambda: " ".join(word() for _ in range(r.randint(1, 16))) + r.choice(["", " " + phrase]) + " " + word()
    bench = [(k, item()) for k in range(25)]
    bench += [(25 + k, t.replace("3", "7").replace("Ann", "Zoe")) for k, (_, t) in enumerate(bench[:12])] + [(40, None), (41, "3 4 5 kg 3 4"), (42, "fox"), (43, "")]
    docs = []
    for k in range(70):
        t = r.choice(bench)[1] or ""
        t = t.replace("4", r.choice("468")).replace("Bob", r.choice(["Bob", "Eve"]))
        if r.random() < 0.4:
            words = t.split()
            words[r.randrange(len(words)) if words else 0 :][:1] = [word()]
            t = " ".join(words)
        docs.append((k, " ".join([*(word() for _ in range(r.randint(0, 9))), t, *(word() for _ in range(r.randint(0, 9)))])))
    left, right = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    of = {}
    for x in templates.members(right).collect():
        of.setdefault(x.representative, set()).add(x.item_id)
    rows = templates.leaks(left, right).collect()
    assert all(x.n_items == len(of[x.item_id]) for x in rows)
    got = {(x.doc_id, i, x.covered) for x in rows for i in of[x.item_id]}
    want = {(d, i, n) for d, t in docs for i, u in bench if (n := brute_leaks(t, u)) is not None}
    assert got == want and len(want) > 70 and any(len(x) > 1 for x in of.values())


def test_many_items_of_one_frame_are_one_class(spark):
    frame = "A train leaves the old station at {} and travels {} miles before it meets Mr {} who left at {} with a heavy bag"
    bench = spark.range(5000).selectExpr("id item_id", "format_string('" + frame.replace("{}", "%s") + "', id + 10000, id + 20000, concat('N', translate(string(id), '0123456789', 'abcdefghij')), id + 30000) text")
    docs = spark.createDataFrame([(k, "Before it. " + frame.format(k + 1, k + 2000, "Smith", k + 7000) + " and after.") for k in range(200)] + [(200, "A train leaves the old station at noon.")], "doc_id long, text string")
    rows = templates.leaks(docs, bench).collect()
    assert sorted(x.doc_id for x in rows) == list(range(200))
    assert {(x.item_id, x.n_items) for x in rows} == {(0, 5000)}


def test_templates_of_very_long_texts(spark):
    docs = spark.createDataFrame([(1, "lorem ipsum dolor 5 sit. " * 60_000 + ITEM), (2, "lorem ipsum dolor 5 sit. " * 60_000)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert [(x.doc_id, x.item_id) for x in templates.leaks(docs, bench).collect()] == [(1, 1)]


def test_runs_are_shuffled_narrow(spark, monkeypatch):
    """Which runs repeat is told by a count for each run; the hash of a text goes along only for ids of several texts."""
    plans, rows, inner = [], {}, spans.staged

    def staged(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        out = inner(df)
        if "first" in out.columns:
            rows.update({(x.doc_id, x.row != 0) for x in out.select("doc_id", "row").collect()} if not rows else {})
        return out

    monkeypatch.setattr(spans, "staged", staged)
    one = "It is the first of all. It goes on for some more words here. It ends at last with this line. "
    two = "Nobody knows what comes after that. Another line says a little more of it. The third one ends the text now. "
    docs = spark.createDataFrame([(1, one), (2, one + two), (2, two), (3, two), (None, two)], "doc_id long, text string")
    got = sorted((x.doc_id or 0, x.text, x.sentences_removed) for x in spans.remove_repeated_spans(docs).collect())
    assert rows == {1: False, 2: True, 3: False}
    assert not any("max(xxhash64(doc_id" in p for p in plans)
    assert got[0] == (0, two, 0) and got[1] == (1, one, 0) and got[4][1:] == ("", 3)
    # the two texts of id 2 share `two`: the one of the smaller hash keeps it
    assert sorted(x[2] for x in got[2:4]) in ([0, 6], [3, 3])


def test_cuts_equal_the_rule_and_are_made_once(monkeypatch):
    """Sentences end where the rule, as a pattern, says, on any code points; a text with runs to take out is cut once."""
    import random
    import re

    import pyarrow as pa

    from panelyard.llm import spans

    rule = re.compile(r"(?<=[.!?])\s+|\s*\n\s*|(?<=\w)\s+(?=[^\W\d_a-zß-öø-ÿ])")
    r = random.Random(4)
    texts = ["", " ", "\n", " A", "A ", "a A", "a. A ", "One two.\n\n Three"]
    texts += ["".join(r.choice(" \n\t\x0b\r\x1c\x85\xa0　.!?_aAéÉßÀ1²Ⅷǅ中😀,") for _ in range(r.randint(1, 14))) for _ in range(3000)]
    monkeypatch.setattr(spans, "PIECE", 100)
    for t in texts:
        want = [m.end() for m in rule.finditer(t)]
        want += [len(t)] if t and (not want or want[-1] != len(t)) else []
        assert [b for _, b in spans.sentences(t)] == want
    made, cut = [], spans._cut
    monkeypatch.setattr(spans, "_cut", lambda t: made.append(t) or cut(t))
    text = "One two. Three four. Five six. Seven."
    batch = pa.RecordBatch.from_arrays([pa.array([text]), pa.array([[0]], pa.list_(pa.int32())), pa.array([1])], ["text", "firsts", "copy"])
    (out,) = spans._cut_out(0, 1, ["text", "removed"], 2, 3)([batch])
    assert out.to_pylist() == [{"text": "Five six. Seven.", "removed": 2}] and made == [text]

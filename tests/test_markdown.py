"""Blocks and segments of Markdown: cases by hand, and blocks that are written and read again."""

import random

from tessella.functions.markdown import blocks, parsed, rows, segments


def found(text):
    return [(b.kind, b.level or b.lang or None, [" ".join(i) if b.kind != "code" else "\n".join(i) for i in b.items]) for b in blocks(text)]


def test_blocks():
    assert found("# One\n## Two ##  \ntext\nmore\n\nlast") == [("heading", 1, ["One"]), ("heading", 2, ["Two ##"]), ("paragraph", None, ["text more"]), ("paragraph", None, ["last"])]
    assert found("```py\n# no heading\n\n- no list\n```\nafter") == [("code", "py", ["# no heading\n\n- no list"]), ("paragraph", None, ["after"])]
    assert found("~~~\nnever closed\n") == [("code", None, ["never closed\n"])]
    assert found("- a\n  goes on\n  - b\n    deep\n* c\n1. d\n2) e\n  - f\ng") == [("bullets", None, ["a goes on", "b deep", "c"]), ("numbers", None, ["d", "e - f"]), ("paragraph", None, ["g"])]
    assert found("> a\n>b\nc\n> d") == [("quote", None, ["a b"]), ("paragraph", None, ["c"]), ("quote", None, ["d"])]
    assert found("---\n* * *\n__\n- - -x") == [("rule", None, []), ("rule", None, []), ("paragraph", None, ["__"]), ("bullets", None, ["- -x"])]
    assert found("- a\n* * *\n\n* * *") == [("bullets", None, ["a", "* *"]), ("rule", None, [])]
    assert found("#no\n####### no\n    # no\n   # yes") == [("paragraph", None, ["#no ####### no # no"]), ("heading", 1, ["yes"])]
    assert found("a\r\nb\rc") == [("paragraph", None, ["a b c"])] and found("") == [] and found(" \n\t\n") == []
    assert found("- a\n  ```\n  x\n```\ncode") == [("bullets", None, ["a ``` x"]), ("code", None, ["code"])]


def test_segments():
    assert segments("a **b** *c* `d*e*` ~~f~~ g") == [("plain", "a ", None), ("bold", "b", None), ("plain", " ", None), ("italic", "c", None), ("plain", " ", None), ("code", "d*e*", None), ("plain", " ", None), ("struck", "f", None), ("plain", " g", None)]
    links = {"https://x.y/z": True, "HTTP://x": True, "mailto:a@b": True, "#top": True, "/abs": True, "?q=1": True, "docs/a.md": True, "javascript:alert(1": False, "data:text/html,x": False, "vbscript:x": False, "a.md": False, "//host/x": True}
    for href, safe in links.items():
        assert segments(f"[t]({href})")[0] == (("link", "t", href) if safe else ("plain", "t", None))
    assert segments("[a](b c) [](x/) ** `") == [("plain", "[a](b c) ", None), ("link", "", "x/"), ("plain", " ** `", None)] and segments("") == []


def test_written_blocks_are_read_again():
    rng = random.Random(3)
    words = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "d3lta"]) for _ in range(rng.randrange(1, 5)))
    for _ in range(200):
        want, text = [], ""
        for _ in range(rng.randrange(1, 7)):
            kind = rng.choice(["heading", "paragraph", "bullets", "numbers", "quote", "code", "rule"])
            own = [words() for _ in range(rng.randrange(1, 4))]
            if kind == "heading":
                level = rng.randrange(1, 7)
                want.append((kind, level, own[:1]))
                text += "#" * level + " " + own[0] + "\n"
            elif kind == "paragraph":
                want.append((kind, None, [" ".join(own)]))
                text += "\n".join(own) + "\n"
            elif kind in ("bullets", "numbers"):
                want.append((kind, None, own))
                text += "".join(f"{'-' if kind == 'bullets' else f'{k}.'} {x}\n" for k, x in enumerate(own))
            elif kind == "quote":
                want.append((kind, None, [" ".join(own)]))
                text += "".join(f"> {x}\n" for x in own)
            elif kind == "code":
                want.append((kind, "sh", ["\n".join(own)]))
                text += "```sh\n" + "\n".join(own) + "\n```\n"
            else:
                want.append((kind, None, []))
                text += "***\n"
            text += "\n"
        assert found(text) == want


def test_rows(spark):
    text = "# T *x*\n\n- a `b`\n- [c](https://d)\n\n---\n```\nz\n```"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "p\n" * 3), (None, "q")], "id bigint, text string")
    got = parsed(df, "id", "text").collect()
    plain = [(r["block"], r["kind"], r["level"], r["lang"], r["item"], r["text"], [tuple(s) for s in r["segments"]]) for r in got if r["id"] == 1]
    assert plain == list(rows(text)) and [p[1] for p in plain] == ["heading", "bullets", "bullets", "rule", "code"]
    assert sorted((str(r["id"]), r["text"]) for r in got if r["id"] != 1) == [("4", "p p p"), ("None", "q")]

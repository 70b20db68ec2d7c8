"""Keyword gates of the licence rules against texts made of one match alone."""

import random
import re

from pagetwin.llm import licenses

parser = re._parser


def sample(items, rng):
    out = ""
    for op, arg in items:
        op = str(op)
        if op == "LITERAL":
            out += chr(arg)
        elif op == "SUBPATTERN":
            out += sample(arg[-1], rng)
        elif op == "BRANCH":
            out += sample(rng.choice(arg[1]), rng)
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, part = arg
            out += "".join(sample(part, rng) for _ in range(rng.randint(low, min(high, low + 2))))
        elif op == "IN":
            kinds = [str(k) for k, _ in arg]
            if kinds == ["CATEGORY"]:
                out += "7" if "DIGIT" in str(arg[0][1]) and "NOT" not in str(arg[0][1]) else "q"
            else:
                out += chr(rng.choice([v for k, v in arg if str(k) == "LITERAL"]))
        else:
            assert op in ("ASSERT", "ASSERT_NOT"), op
    return out


def test_gates_let_every_match_through():
    rng, scanner = random.Random(5), licenses.Scanner()
    for r in scanner.rules:
        for _ in range(12):
            text = sample(parser.parse(r.pattern.pattern), rng)
            assert r.pattern.search(f" {text} "), (r.pattern.pattern, text)
            assert r.gate <= set(text.split()), (r.pattern.pattern, text)


def test_public_domain():
    labels = lambda t: [(d["label"], d["weight"]) for d in licenses.Scanner().scan(t)["detections"]]
    assert labels("It was released into the Public Domain.") == labels("It is in the public domain.") == [("public-domain", 0.8)]

"""A second matcher, written from the rules alone and without the engine's code, for the default vocabulary."""

import re

PAIRS = "aáàâäãåāąÁÀÂÄÃÅ eéèêëēėęÉÈÊË iíìîïīįÍÌÎÏ oóòôöõøōÓÒÔÖÕ uúùûüūÚÙÛÜ nñńÑ cçćčÇĆČ sšśŠŚ zžźżŽŹŻ yýÿÝ lłŁ".split()
PLAIN = {c: p[0] for p in PAIRS for c in p[1:]}


def words(text):
    out = ""
    for c in text:
        c = PLAIN.get(c, c)
        if re.fullmatch("[A-Za-z0-9]", c):
            out += c.lower()
        elif c == ".":
            out += c
        elif c in "#/":
            out += f" {c} "
        else:
            out += " "
    return out.split()


def meanings(ws):
    out = []
    for i, w in enumerate(ws):
        year = re.fullmatch(r"\d{4}", w, re.A) and 1900 <= int(w) <= 2099
        near = (i and ws[i - 1] in "#/") or (i + 1 < len(ws) and ws[i + 1] == "/")
        out.append(f"y{w}" if year and not near else f"t{w}")
    return out


def said(text):
    return {m for m in meanings(words(text)) if m not in ("t#", "t/")}


def clauses(query):
    """(negated, kind, body) or None if the query does not parse."""
    out, i = [], 0
    while i < len(query):
        if query[i].isspace():
            i += 1
            continue
        neg = query[i] == "-"
        i += neg
        if i == len(query) or query[i].isspace():
            return None
        if query[i] in '("':
            j = query.find({"(": ")", '"': '"'}[query[i]], i + 1)
            if j < 0:
                return None
            body = query[i + 1 : j]
            if query[i] == "(":
                body = [m.strip() for m in body.split(",") if m.strip()]
                if not body or len(body) > 64:
                    return None
                out.append((neg, "any", body))
            else:
                out.append((neg, "phrase", body.strip()))
            i = j + 1
        else:
            m = re.match(r'[^\s("]+', query[i:])
            out.append((neg, "word", m[0]))
            i += m.end()
    return out if len(out) <= 256 else None


def matches(query, title, keep_negative=False):
    cs = clauses(query)
    if cs is None:
        return False
    has, line = said(title), meanings(words(title))
    ok, positive, negative, run = True, False, False, []

    def within(phrase):
        p = meanings(words(phrase))
        return any(line[i : i + len(p)] == p for i in range(len(line) - len(p) + 1))

    def end_run():
        nonlocal ok, positive
        if run and (need := said(" ".join(run))):
            positive = True
            ok &= need <= has
        run.clear()

    for neg, kind, body in cs:
        if kind == "word" and not neg:
            run.append(body)
            continue
        end_run()
        if kind == "phrase":
            if words(body):
                ok &= within(body) != neg
                negative, positive = negative or neg, positive or not neg
            continue
        sets = [s for b in (body if kind == "any" else [body]) if (s := said(b))]
        if sets:
            hit = any(s <= has for s in sets)
            ok &= hit != neg
            negative, positive = negative or neg, positive or not neg
    end_run()
    return bool(ok and (positive or keep_negative and negative))

"""Documents for tests, made by rule, and a small path evaluator on element trees to hold the engine against."""

import xml.etree.ElementTree as ET

from xylem.plans.xpath_ast import Attribute, Child, Index, Last, Position, parse_xpath


def river(gauges: int = 6) -> str:
    """Gauges of a river: a number, a level that is CDATA at odd ones, a mark at every third, readings as many as the number mod 4."""
    out = []
    for i in range(gauges):
        level = f"<![CDATA[{i * 7}]]>" if i % 2 else str(i * 7)
        reads = "".join(f"<r t='{j}'>{(i + 2) * j}</r>" for j in range(i % 4))
        out.append(f'<gauge km="{i * 11}" bank="{"left" if i % 2 else "right"}"><level>{level}</level>{"<dry/>" if i % 3 == 0 else ""}<log>{reads}</log></gauge>')
    return f"<river>{''.join(out)}</river>"


def nest(depth: int, width: int = 2) -> str:
    """The same name at every depth; leaves hold the way to them."""
    def box(way: str) -> str:
        if len(way) == depth:
            return f'<box w="{way}">{way}</box>'
        return f'<box w="{way}">' + "".join(box(way + str(k)) for k in range(width)) + "</box>"

    return box("")


def flags(rows: int = 5) -> str:
    """Empty elements with attributes in both quotes, signs of markup and other scripts in their values."""
    return "<flags>" + "".join(f"<f no=\"{i}\" say='{c}' to=\"a&gt;{c}/b\"/>" for i, c in zip(range(rows), "xé=ß~", strict=False)) + "</flags>"


RIVER, NEST, FLAGS = river(), nest(3), flags()

CASES = [
    (RIVER, "/river", 1), (RIVER, "/river/gauge", 6), (RIVER, "river/gauge/dry/", 2), (RIVER, "/river/gauge/level", ["0", "7", "14", "21", "28", "35"]),
    (RIVER, "/river/gauge[@km='33']/level", ["21"]), (RIVER, "/river/gauge[@bank=\"left\"]/level", ["7", "21", "35"]), (RIVER, "/river/gauge[@km>'30']/level", ["21", "28", "35"]),
    (RIVER, "/river/gauge[@km>='33']/dry", 1), (RIVER, "/river/gauge[@km<='11']/level", ["0", "7"]), (RIVER, "/river/gauge[@km!='0']", 5), (RIVER, "/river/gauge[@km='3']", 0),
    (RIVER, "/river/gauge[level=21]/log/r", ["0", "5", "10"]), (RIVER, "/river/gauge[level>'20']/log/r[1]", ["5"]), (RIVER, "/river/gauge[level<14]", 2),
    (RIVER, "/river/gauge[2]/log/r", ["0", "4"]), (RIVER, "/river/gauge[3]/log/r[2]", ["10"]), (RIVER, "/river/gauge[last()]/level", ["35"]), (RIVER, "/river/gauge[last()-1]/level", ["28"]),
    (RIVER, "/river/gauge[position()>4]/level", ["28", "35"]), (RIVER, "/river/gauge/log[r=4]/r[@t='0']", ["0"]), (RIVER, "/river/gauge/log[r>=10]", 1), (RIVER, "/river/gauge/log[r<=0]", 4),
    (RIVER, "/river/gauge[level>=7]/log[r=4]/r", ["0", "4"]), (RIVER, "/river/gauge[level=7]/log[r=7]", 0), (RIVER, "/river/none", 0), (RIVER, "/river/gauge[level=none]", 0),
    (NEST, "/box", 1), (NEST, "/box/box/box", 4), (NEST, "/box/box/box/box", [f"{a}{b}{c}" for a in "01" for b in "01" for c in "01"]), (NEST, "/box/box[1]/box[0]/box[1]", ["101"]),
    (NEST, "/box/box/box[box=011]", 1), (NEST, "/box/box[@w='1']/box/box[last()]", ["101", "111"]), (NEST, "/box[0]/box[@w!='1']/box[1]/box", ["010", "011"]), (NEST, "/box/box/box/box/box", 0),
    (FLAGS, "/flags/f", 5), (FLAGS, "/flags/f[@say='é']", 1), (FLAGS, "/flags/f[@say='=']", 1), (FLAGS, "/flags/f[position()<=2]", 2), (FLAGS, "/flags/f[@no<'3']", 3),
]


def damaged() -> list[str]:
    """Each way in which tags can fail to match, at every place of a small document where it applies."""
    parts = ["<t>", "<u>", "1", "</u>", "<u/>", "<v k='2'>", "</v>", "</t>"]
    out = []
    for i, p in enumerate(parts):
        if p.startswith("<") and not p.endswith("/>"):
            out.append("".join(parts[:i] + parts[i + 1 :]))  # a tag is missing
        if p.startswith("</"):
            out.append("".join([*parts[:i], p[:-1] + "x>", *parts[i + 1 :]]))  # it closes another name
            out.append("".join([*parts[: i + 1], p, *parts[i + 1 :]]))  # it closes twice
    out += ["<t><u><v></u></v></t>", "</t>", "<t></t></t><t>", "".join(parts[:-1]), "".join(parts)[:-1], "<t k='1"]
    return out + [f"{head}{''.join(parts)}" for head in ("<?xml version='1.1'?>", "<!-- a -->", "<!DOCTYPE t>")]


BAD = damaged()
GOOD = [RIVER, NEST, FLAGS, "<t k='1'/>", "<t><![CDATA[</t><u>]]></t>", "<t/><u/>", "<t></t >", "<t\n k='1'\n>a</t>", "<t>a ]]> b</t>", "<t k='a > b'>c</t>", '<t>="</t>']


def text_of(node):
    return None if len(node) else (node.text or "")


def evaluate(xml: str, path: str) -> list:
    """The matched nodes, by walking the tree."""
    def keep(node, siblings, p):
        same = [s for s in siblings if s.tag == node.tag]
        i = next(k for k, s in enumerate(same) if s is node)
        match p:
            case None:
                return True
            case Index(n):
                return i == n
            case Position(op, n):
                return {"=": i + 1 == n, "!=": i + 1 != n, "<": i + 1 < n, ">": i + 1 > n, "<=": i + 1 <= n, ">=": i + 1 >= n}[op]
            case Last(back):
                return i == len(same) - 1 - back
            case Attribute(name, op, value):
                return name in node.attrib and compare(node.attrib[name], op, value)
            case Child(name, op, value):
                return any(c.tag == name and text_of(c) is not None and compare(text_of(c), op, value) for c in node)

    def compare(a, op, b):
        if op in ("=", "!="):
            return (a == b) == (op == "=")
        try:
            a, b = float(a), float(b)
        except ValueError:
            pass
        return {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]

    level = [[ET.fromstring(xml)]]
    for step in parse_xpath(path):
        found = [n for group in level for n in group if n.tag == step.name and keep(n, group, step.predicate)]
        level = [list(n) for n in found]
    return found

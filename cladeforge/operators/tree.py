"""Rooted binary trees on the driver (they are small) and their DataFrame form.

Node ids are true pre-order numbers from 1, so a subtree is an interval of ids, and the lowest common ancestor of any set is that of its least and greatest id.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

NODES = "node_id int, name string, type string, parent int, distance double, coordinate array<int>, nchildren int, subtree_end int, depth int, path array<struct<id:int,end:int>>"


@dataclass
class Node:
    name: str | None = None
    distance: float = 0.0
    children: list[Node] = field(default_factory=list)

    @property
    def leaf(self) -> bool:
        return not self.children

    def preorder(self) -> list[Node]:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            out.append(node)
            stack.extend(reversed(node.children))
        return out

    def breadth_first(self) -> list[Node]:
        out = [self]
        for node in out:
            out.extend(node.children)
        return out

    def leaves(self) -> list[Node]:
        return [n for n in self.preorder() if n.leaf]


_TOKEN = re.compile(r"'((?:[^']|'')*)'|([(),:;])|([^(),:;']+)")


def parse_newick(text: str) -> Node:
    """White space between tokens is dropped; quoted names may hold anything."""
    root = at = Node()
    stack: list[Node] = []
    expect_length = False
    for quoted, mark, word in _TOKEN.findall(text):
        if mark == "(":
            child = Node()
            at.children.append(child)
            stack.append(at)
            at = child
        elif mark == ",":
            if not stack:
                raise ValueError("a comma outside brackets")
            at = Node()
            stack[-1].children.append(at)
        elif mark == ")":
            if not stack:
                raise ValueError("a bracket closes that was not opened")
            at = stack.pop()
        elif mark == ";":
            break
        elif mark == ":":
            expect_length = True
            continue
        elif word.strip() or quoted:
            if expect_length:
                at.distance = float(word)
            else:
                at.name = quoted.replace("''", "'") if quoted else re.sub(r"\s+", "", word)
        expect_length = False
    if stack:
        raise ValueError("a bracket is not closed")
    return root


def write_newick(root: Node) -> str:
    done: dict[int, str] = {}
    for node in reversed(root.preorder()):
        name = node.name or ""
        if re.search(r"[\s(),:;']", name):
            name = "'" + name.replace("'", "''") + "'"
        inner = "(" + ",".join(done.pop(id(c)) for c in node.children) + ")" if node.children else ""
        done[id(node)] = inner + name + ("" if node is root else f":{node.distance}")
    return done[id(root)] + ";"


def resolve_polytomies(root: Node) -> Node:
    """While a node has more than two children, the first two go under a new branch of length 0, which comes last."""
    for node in root.preorder():
        while len(node.children) > 2:
            joined = Node(None, 0.0, node.children[:2])
            node.children = [*node.children[2:], joined]
    return root


def number_branches(root: Node, keep_names: bool = False) -> Node:
    """Branches are named 1, 2, ... in pre-order."""
    n = 0
    for node in root.preorder():
        if not node.leaf:
            n += 1
            if not (keep_names and node.name):
                node.name = str(n)
    names = [x.name for x in root.preorder()]
    if twice := {x for x in names if names.count(x) > 1}:
        raise ValueError(f"names are not unique: {sorted(map(str, twice))[:5]}")
    return root


def load_newick(text: str, keep_names: bool = False) -> Node:
    return number_branches(resolve_polytomies(parse_newick(text)), keep_names)


def reduce_tree(root: Node, wanted: set[str]) -> Node:
    """The tree of the wanted nodes: a branch with one wanted side is replaced by that side and the lengths add up; a wanted branch keeps its
    children that are not wanted, as leaves if nothing below them is."""
    kept: dict[int, Node | None] = {}
    for node in reversed(root.preorder()):
        below = [k for c in node.children if (k := kept[id(c)]) is not None]
        if node.name in wanted:
            children = [kept[id(c)] or Node(c.name, c.distance) for c in node.children] if below else []
            kept[id(node)] = Node(node.name, node.distance, children)
        elif len(below) == 1:
            below[0].distance += node.distance
            kept[id(node)] = below[0]
        else:
            kept[id(node)] = Node(node.name, node.distance, below) if below else None
    out = kept[id(root)]
    if out is None:
        raise ValueError("none of the nodes is in the tree")
    return out


def balanced(names: list[str]) -> Node:
    """A balanced tree with lengths 1: pairs are taken from the end; an odd one out goes on to the next level."""
    level, number = [Node(n, 1.0) for n in names], len(names) - 1
    while len(level) > 1:
        above = []
        while len(level) > 1:
            a, b = level.pop(), level.pop()
            above.append(Node(str(number), 1.0, [a, b]))
            number -= 1
        level = level + above
    return level[0]


def splice(template: str, groups: dict[str, str]) -> str:
    """{{group}} in a template becomes that group's tree."""
    out = re.sub(r"\{\{(\w+)\}\}", lambda m: groups[m[1]].strip().rstrip(";"), template).strip()
    return out if out.endswith(";") else out + ";"


def insert_above(root: Node, name: str, new: Node, branch: str | None = None, distance: float = 0.0) -> Node:
    """A new branch takes the place of ``name`` and holds it and ``new``."""
    for node in root.preorder():
        for i, child in enumerate(node.children):
            if child.name == name:
                node.children[i] = Node(branch, distance, [child, new])
                return root
    if root.name == name:
        return Node(branch, distance, [root, new])
    raise KeyError(name)


def remove(root: Node, name: str) -> Node:
    """A leaf or subtree goes; a branch left with one child gives way to it."""
    if root.name == name:
        raise ValueError("the root cannot go")
    for node in root.preorder():
        node.children = [c for c in node.children if c.name != name]
    gone: dict[int, Node] = {}
    for node in reversed(root.preorder()):
        node.children = [gone.get(id(c), c) for c in node.children]
        if len(node.children) == 1 and node is not root:
            only = node.children[0]
            only.distance += node.distance
            gone[id(node)] = only
    return root.children[0] if len(root.children) == 1 else root


def rows_of(root: Node) -> list[tuple]:
    """Rows of NODES in pre-order."""
    order = root.preorder()
    ids = {id(n): i + 1 for i, n in enumerate(order)}
    size: dict[int, int] = {}
    for n in reversed(order):
        size[id(n)] = sum(size[id(c)] + 1 for c in n.children)
    place: dict[int, tuple[int | None, int, list[int], list[tuple[int, int]]]] = {id(root): (None, 0, [], [])}
    out = []
    for n in order:
        i = ids[id(n)]
        parent, depth, coordinate, path = place[id(n)]
        end = i + size[id(n)]
        own = [*path, (i, end)]
        for j, c in enumerate(n.children):
            place[id(c)] = (i, depth + 1, [j, *coordinate], own)
        out.append((i, n.name, "Leaf" if n.leaf else "Branch", parent, float(n.distance), coordinate, size[id(n)], end, depth, own))
    return out


def local_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A driver's rows as a local relation, whose size the planner knows, so that joins with it broadcast by themselves."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    fields = to_arrow_schema(_parse_datatype_string(schema))

    def cell(x, kind: pa.DataType):
        if pa.types.is_list(kind) and x is not None:
            return [cell(y, kind.value_type) for y in x]
        if pa.types.is_struct(kind) and x is not None:
            return {f.name: cell(y, f.type) for f, y in zip(kind, x, strict=True)}
        return x

    columns = [pa.array([cell(r[i], f.type) for r in rows], f.type) for i, f in enumerate(fields)]
    return spark.createDataFrame(pa.table(columns, schema=fields))


def nodes_frame(spark: SparkSession, root: Node) -> DataFrame:
    return local_frame(spark, rows_of(root), NODES)


def lca_of(root: Node, names: list[str]) -> str:
    """The longest common suffix of coordinates names the lowest common ancestor."""
    rows = rows_of(root)
    coordinates = {r[1]: r[5] for r in rows}
    shared = coordinates[names[0]]
    for name in names[1:]:
        other, n = coordinates[name], 0
        while n < min(len(shared), len(other)) and shared[len(shared) - 1 - n] == other[len(other) - 1 - n]:
            n += 1
        shared = shared[len(shared) - n :]
    return next(r[1] for r in rows if r[5] == shared)

"""Graph exports: JSON and DOT built by Spark, HTML viewers around at most a few hundred collected rows."""

from __future__ import annotations

import html
import json
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A palette that colour-blind readers can tell apart (Okabe and Ito), by kind.
COLOURS = {"function": "#0072B2", "method": "#56B4E9", "class": "#E69F00", "interface": "#009E73", "route": "#CC79A7"}
OTHER = "#999999"
#: Nodes and edges that a drawing may have; larger exports stay relations.
MOST_DRAWN = 20_000


def _bounded(df: DataFrame) -> list:
    rows = df.limit(MOST_DRAWN + 1).collect()
    if len(rows) > MOST_DRAWN:
        raise ValueError(f"more than {MOST_DRAWN} rows to draw: use a smaller limit, or the relations themselves")
    return rows


def to_json(nodes: DataFrame, edges: DataFrame) -> str:
    """One document {nodes, edges}; both sides are the capped lists of an export."""
    pick = lambda df: [json.loads(r[0]) for r in _bounded(df.select(F.to_json(F.struct("*"))))]
    return json.dumps({"nodes": pick(nodes.orderBy("id")), "edges": pick(edges.orderBy("from", "to", "label"))}, ensure_ascii=False)


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(o, line): the statements of a DOT graph, in order of ``o``."""
    quote = lambda c: F.replace(c, F.lit('"'), F.lit('\\"'))
    fill = F.coalesce(*[F.when(F.col("group") == k, c) for k, c in COLOURS.items()], F.lit(OTHER))
    a = nodes.select(F.concat(F.lit("1"), "id").alias("o"), F.concat(F.lit('  "'), "id", F.lit('" [label="'), quote(F.col("label")), F.lit('", fillcolor="'), fill, F.lit('"];')).alias("line"))
    b = edges.select(F.concat(F.lit("2"), "from", "to", "label").alias("o"), F.concat(F.lit('  "'), "from", F.lit('" -> "'), "to", F.lit('" [label="'), quote(F.col("label")), F.lit('"];')).alias("line"))
    return a.unionByName(b)


def to_dot(nodes: DataFrame, edges: DataFrame) -> str:
    body = [r["line"] for r in _bounded(dot_lines(nodes, edges).orderBy("o"))]
    return "\n".join(["digraph quillgraph {", "  rankdir=LR;", '  node [style=filled, fontname="sans-serif"];', *body, "}"])


def layout(n: int, links: list[tuple[int, int]], spacing: float = 48.0, rounds: int = 150) -> np.ndarray:
    """n x 2 positions by the force-directed placement of Fruchterman and Reingold (1991), the same for the same graph.

    Nodes start on a spiral of equal areas. Every two push each other away by spacing^2 / distance, linked ones are drawn
    together by distance^2 / spacing, and no step is longer than a temperature that falls to zero.
    """
    at = np.arange(n)
    turn = at * (math.pi * (3 - math.sqrt(5)))
    pos = spacing * np.sqrt(at + 0.5)[:, None] * np.stack([np.cos(turn), np.sin(turn)], axis=1)
    ends = np.array([x for x in links if x[0] != x[1]], dtype=np.int64).reshape(-1, 2)
    for step in range(rounds if n > 1 else 0):
        move = np.zeros_like(pos)
        for lo in range(0, n, 512):
            apart = pos[lo : lo + 512, None] - pos[None]
            far2 = np.maximum(np.einsum("ijk,ijk->ij", apart, apart), 1e-6)
            move[lo : lo + 512] = np.einsum("ijk,ij->ik", apart, spacing**2 / far2)
        along = pos[ends[:, 0]] - pos[ends[:, 1]]
        pull = along * (np.linalg.norm(along, axis=1, keepdims=True) / spacing)
        np.subtract.at(move, ends[:, 0], pull)
        np.add.at(move, ends[:, 1], pull)
        size = np.maximum(np.linalg.norm(move, axis=1, keepdims=True), 1e-9)
        heat = 2 * spacing * (1 - step / rounds) ** 2
        pos = pos + move / size * np.minimum(size, heat)
    return pos - pos.mean(axis=0) if n else pos


_PAGE = """<!doctype html>
<html><head><meta charset="utf-8"><title>{title}</title><style>html,body,#view{{margin:0;width:100%;height:100%}}body{{background:#fff;color:#222;font:12px system-ui,sans-serif}}line{{stroke:#bbb}}</style>{head}</head>
<body><div id="view"></div><script>const graph = {data};{script}</script></body></html>"""

_DRAWING = """
const NS="http://www.w3.org/2000/svg",svg=document.createElementNS(NS,"svg"),byId=new Map(graph.nodes.map(n=>[n.id,n]));
const put=(tag,attrs,to)=>{const e=document.createElementNS(NS,tag);for(const k in attrs)e.setAttribute(k,attrs[k]);to.append(e);return e};
const xs=graph.nodes.map(n=>n.x),ys=graph.nodes.map(n=>n.y),lo=[Math.min(0,...xs)-60,Math.min(0,...ys)-60],view={x:lo[0],y:lo[1],w:Math.max(0,...xs)-lo[0]+120,h:Math.max(0,...ys)-lo[1]+60};
const show=()=>svg.setAttribute("viewBox",[view.x,view.y,view.w,view.h].join(" "));
svg.style.cssText="width:100%;height:100%";document.getElementById("view").append(svg);
for(const e of graph.edges){const a=byId.get(e.from),b=byId.get(e.to);if(a&&b)put("line",{x1:a.x,y1:a.y,x2:b.x,y2:b.y},svg)}
for(const n of graph.nodes){const g=put("g",{},svg);put("circle",{cx:n.x,cy:n.y,r:6,fill:n.color},g);put("text",{x:n.x+8,y:n.y+4},g).textContent=n.label;put("title",{},g).textContent=n.title}
svg.addEventListener("wheel",e=>{e.preventDefault();const r=svg.getBoundingClientRect(),px=view.x+view.w*(e.clientX-r.left)/r.width,py=view.y+view.h*(e.clientY-r.top)/r.height,s=Math.exp(e.deltaY/600);view.x=px-(px-view.x)*s;view.y=py-(py-view.y)*s;view.w*=s;view.h*=s;show()},{passive:false});
svg.addEventListener("pointermove",e=>{if(e.buttons&1){const r=svg.getBoundingClientRect();view.x-=e.movementX*view.w/r.width;view.y-=e.movementY*view.h/r.height;show()}});show();"""

_LIBRARY = """new vis.Network(document.getElementById("view"),{nodes:new vis.DataSet(graph.nodes),edges:new vis.DataSet(graph.edges.map(e=>({...e,arrows:"to"})))},{nodes:{shape:"dot",font:{color:"#222222"}}});"""


def to_html(nodes: DataFrame, edges: DataFrame, inline: bool = True, title: str = "Code graph") -> str:
    """A page that draws the graph, by itself (``inline``) or with a library from a public CDN."""
    data = json.loads(to_json(nodes, edges))
    for n in data["nodes"]:
        n["color"] = COLOURS.get(n["group"], OTHER)
    if inline:
        index = {n["id"]: i for i, n in enumerate(data["nodes"])}
        where = layout(len(index), [(index[e["from"]], index[e["to"]]) for e in data["edges"] if e["from"] in index and e["to"] in index])
        for n, (x, y) in zip(data["nodes"], where.tolist()):
            n["x"], n["y"] = round(x, 2), round(y, 2)
    safe = json.dumps(data, ensure_ascii=False).replace("</", "<\\/")
    head = "" if inline else '<script src="https://unpkg.com/vis-network/standalone/umd/vis-network.min.js"></script>'
    return _PAGE.format(title=html.escape(title), head=head, data=safe, script=_DRAWING if inline else _LIBRARY)

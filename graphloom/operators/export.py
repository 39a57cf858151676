"""Parts of a graph as JSON, DOT and what an HTML viewer shows, and the viewer's filters."""
from __future__ import annotations

import html
import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import is_symbol
from .diff import _lookup, group_of
from .graph import Graph, induced, top_by_degree

# Colours of the drawing.
NODE_COLOURS = {"Class": "#4FC3F7", "Interface": "#81C784", "Function": "#FFB74D", "Method": "#FF8A65", "Enum": "#CE93D8"}
EDGE_COLOURS = {"CALLS": "red", "IMPORTS": "blue", "EXTENDS": "green", "IMPLEMENTS": "green", "CONTAINS": "gray"}


def json_part(graph: Graph, limit: int | None = None) -> Graph:
    """Symbols and files, the first `limit` by id, and the edges among them."""
    nodes = graph.nodes.filter(is_symbol(F.col("label")) | (F.col("label") == "File"))
    nodes = nodes.orderBy("id").limit(limit) if limit is not None else nodes
    return Graph(nodes, induced(graph.edges, nodes.select("id")))


def write_json(graph: Graph, path: str, limit: int | None = None) -> None:
    """nodes/ and edges/ of JSON lines, written by the executors."""
    part = json_part(graph, limit)
    part.nodes.write.mode("overwrite").json(f"{path}/nodes")
    part.edges.write.mode("overwrite").json(f"{path}/edges")


def _dot_id(c: Column) -> Column:
    return X.sanitize(c)


def dot_lines(graph: Graph, limit: int = 500) -> DataFrame:
    """part (0 nodes, 1 edges), id, line of the first symbols by id and the edges among them."""
    nodes = graph.nodes.filter(is_symbol(F.col("label"))).orderBy("id").limit(limit)
    n = F.concat(F.lit("  "), _dot_id(F.col("id")), F.lit(' [label="'), "name", F.lit("\\n("), "label", F.lit(')", fillcolor="'), _lookup(F.col("label"), NODE_COLOURS, "#E0E0E0"), F.lit('"];'))
    e = F.concat(F.lit("  "), _dot_id(F.col("source_id")), F.lit(" -> "), _dot_id(F.col("target_id")), F.lit(" [color="), _lookup(F.col("rel_type"), EDGE_COLOURS, "black"), F.lit(', label="'), "rel_type", F.lit('"];'))
    return nodes.select(F.lit(0).alias("part"), "id", n.alias("line")).unionByName(induced(graph.edges, nodes.select("id")).select(F.lit(1).alias("part"), "id", e.alias("line")))


def dot_text(graph: Graph, limit: int = 500) -> str:
    """One document; `limit` symbols bound it."""
    lines = [r["line"] for r in dot_lines(graph, limit).orderBy("part", "id").collect()]
    return "\n".join(["digraph code {", "  rankdir=LR;", "  node [shape=box, style=filled];", "", *lines, "}", ""])


def html_part(graph: Graph, limit: int = 3000) -> Graph:
    """The viewer's nodes (those with the most edges) and links (all but CONTAINS among them)."""
    top = top_by_degree(graph, limit)
    path = F.col("file_path")
    nodes = top.select(
        "id", "name", "label", path.alias("file"), X.basename(path).alias("file_name"), X.dirname(path).alias("folder"), F.coalesce("start_line", F.lit(0)).alias("line"), F.col("is_exported").alias("exported"), group_of(F.col("label")).alias("group"),
        "degree", "in_degree", "out_degree", F.coalesce("return_type", F.lit("")).alias("return_type"), "is_async",
    )
    links = induced(graph.edges.filter("rel_type <> 'CONTAINS'"), top.select("id"))
    return Graph(nodes, links.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.col("rel_type").alias("type"), "confidence"))


def graph_data(graph: Graph, limit: int = 3000) -> dict:
    """The viewer's data; `limit` nodes bound it."""
    part = html_part(graph, limit)
    return {"mode": "graph", "nodes": [r.asDict() for r in part.nodes.collect()], "links": [r.asDict() for r in part.edges.collect()]}


def html_text(graph: Graph, limit: int = 3000, title: str = "Code graph") -> str:
    data = graph_data(graph, limit)
    return page(data, title, f"{len(data['nodes'])} symbols | {len(data['links'])} connections")


_PAGE = """<!DOCTYPE html><html><head><meta charset="utf-8"><title>@title</title><style>
body{margin:0;font:14px sans-serif;display:flex;height:100vh}canvas{flex:1;min-width:0}aside{width:22em;overflow:auto;padding:1em;border-left:1px solid #ccc}
li{cursor:pointer;list-style:none}ul{padding:0}label{margin-right:.6em}</style></head><body><canvas id="c"></canvas>
<aside><h3>@title</h3><p>@stats</p><input id="q" placeholder="name"><div id="f"></div><ul id="r"></ul><div id="d"></div></aside>
<script id="data" type="application/json">@data</script><script>
const data=JSON.parse(document.getElementById("data").textContent),nodes=data.nodes,links=data.links,at=new Map(nodes.map(n=>[n.id,n]));
const $=i=>document.getElementById(i),c=$("c"),g=c.getContext("2d"),colours=["#9e9e9e","#4FC3F7","#81C784","#FFB74D","#FF8A65","#CE93D8","#A1887F","#4DB6AC","#90A4AE"];
const fate={added:"#2e7d32",removed:"#c62828",modified:"#ef6c00",moved:"#1565c0",unchanged:"#bdbdbd"},off=new Set(),pick={};let view={x:0,y:0,k:1};
const colour=n=>n.status?fate[n.status]:colours[n.group],kind=n=>[n.label,n.status].filter(x=>x),seen=n=>kind(n).every(x=>!off.has(x));
nodes.forEach((n,i)=>{const r=8*Math.sqrt(i),a=i*2.4;n.x=r*Math.cos(a);n.y=r*Math.sin(a);n.dx=n.dy=0});
const pairs=links.map(l=>({s:at.get(l.source),t:at.get(l.target),l})).filter(p=>p.s&&p.t);
function step(heat){const cell=60,grid=new Map(),key=(x,y)=>Math.floor(x/cell)+":"+Math.floor(y/cell);
 for(const n of nodes){const k=key(n.x,n.y);(grid.get(k)||grid.set(k,[]).get(k)).push(n)}
 for(const n of nodes)for(let i=-1;i<2;i++)for(let j=-1;j<2;j++)for(const m of grid.get(key(n.x+i*cell,n.y+j*cell))||[])if(m!==n){
  const x=n.x-m.x||.1,y=n.y-m.y||.1,d=x*x+y*y+1;n.dx+=90*x/d;n.dy+=90*y/d}
 for(const {s,t} of pairs){const x=t.x-s.x,y=t.y-s.y;s.dx+=x*.02;s.dy+=y*.02;t.dx-=x*.02;t.dy-=y*.02}
 for(const n of nodes){n.x+=heat*(n.dx-n.x*.003);n.y+=heat*(n.dy-n.y*.003);n.dx=n.dy=0}}
function draw(){c.width=c.clientWidth;c.height=c.clientHeight;g.translate(c.width/2+view.x,c.height/2+view.y);g.scale(view.k,view.k);
 for(const {s,t,l} of pairs)if(seen(s)&&seen(t)){g.strokeStyle=l.status?fate[l.status]+"88":"#bbb8";g.beginPath();g.moveTo(s.x,s.y);g.lineTo(t.x,t.y);g.stroke()}
 for(const n of nodes)if(seen(n)){g.fillStyle=colour(n);g.beginPath();g.arc(n.x,n.y,3+Math.min(9,Math.sqrt(n.degree||0)),0,7);g.fill();if(n===pick.n||view.k>2)g.fillText(n.name,n.x+8,n.y)}}
function list(head,rows){const u=document.createElement("ul");u.append(head+" ("+rows.length+")");for(const [text,n] of rows.slice(0,30)){const i=document.createElement("li");i.textContent=text;i.onclick=()=>show(n);u.append(i)}return u}
function show(n){pick.n=n;const d=$("d");d.replaceChildren();const h=document.createElement("p");h.textContent=[n.label,n.name,n.file+":"+n.line,n.status||""].join(" ");
 d.append(h,list("out",pairs.filter(p=>p.s===n).map(p=>[p.l.type+" "+p.t.name,p.t])),list("in",pairs.filter(p=>p.t===n).map(p=>[p.l.type+" "+p.s.name,p.s])));draw()}
$("q").oninput=()=>{const s=$("q").value.toLowerCase(),r=$("r");r.replaceChildren();if(s.length>1)nodes.filter(n=>n.name.toLowerCase().includes(s)&&seen(n)).slice(0,12).forEach(n=>{const i=document.createElement("li");i.textContent=n.label+" "+n.name;i.onclick=()=>show(n);r.append(i)})};
for(const x of [...new Set(nodes.flatMap(kind))].sort()){const l=document.createElement("label"),b=document.createElement("input");b.type="checkbox";b.checked=true;b.onchange=()=>{b.checked?off.delete(x):off.add(x);draw()};l.append(b,x);$("f").append(l)}
c.onwheel=e=>{view.k*=e.deltaY<0?1.2:1/1.2;draw()};c.onmousemove=e=>{if(e.buttons){view.x+=e.movementX;view.y+=e.movementY;draw()}};
c.onclick=e=>{const x=(e.offsetX-c.width/2-view.x)/view.k,y=(e.offsetY-c.height/2-view.y)/view.k;let best=null,m=200;for(const n of nodes){const d=(n.x-x)**2+(n.y-y)**2;if(seen(n)&&d<m){m=d;best=n}}if(best)show(best)};
let turn=0;(function run(){step(1-turn/200);draw();if(++turn<200)requestAnimationFrame(run)})();onresize=draw;
</script></body></html>"""


def page(data: dict, title: str, stats: str) -> str:
    """One file with the data and a viewer: a drawing by forces, a search by name, filters by label and status, and a node's first 30 edges of each side."""
    shown = {"title": html.escape(title), "stats": html.escape(stats), "data": json.dumps(data).replace("</", "<\\/")}
    return re.sub("@(title|stats|data)", lambda m: shown[m[1]], _PAGE)


def write_text(text: str, path: str) -> None:
    Path(path).write_text(text)


def viewer_search(nodes: DataFrame, text: str, labels: tuple[str, ...] | None = None, limit: int = 12, statuses: tuple[str, ...] | None = None) -> DataFrame:
    """Names that contain a text of two characters or more, in any case, of some labels and (in a diff) statuses."""
    if len(text) < 2:
        return nodes.limit(0)
    found = nodes.filter(F.lower("name").contains(text.lower()))
    for column, kept in (("label", labels), ("status", statuses)):
        found = found.filter(F.col(column).isin(*kept)) if kept else found
    return found.orderBy("id").limit(limit)


def viewer_links(links: DataFrame, node_id: str | None, most: int = 30) -> DataFrame:
    """direction, other, type of a node's first links of each side, by type and the other end; no node has none."""
    out = links.filter(F.col("source") == F.lit(node_id)).select(F.lit("out").alias("direction"), F.col("target").alias("other"), "type").orderBy("type", "other").limit(most)
    into = links.filter(F.col("target") == F.lit(node_id)).select(F.lit("in").alias("direction"), F.col("source").alias("other"), "type").orderBy("type", "other").limit(most)
    return out.unionByName(into)

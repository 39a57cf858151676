"""The viewer's script, in Node where that is installed, with just enough of a page around it."""
import json
import shutil
import subprocess

import pytest

from graphloom.operators import export

NODES = [
    {"id": "a", "name": "alpha</script>", "label": "Function", "group": 3, "degree": 2, "file": "f.ts", "line": 1, "status": "added"},
    {"id": "b", "name": "beta", "label": "Class", "group": 1, "degree": 1, "file": "g.ts", "line": 2, "status": "removed"},
]
LINKS = [{"source": "a", "target": "b", "type": "CALLS", "status": "added"}, {"source": "a", "target": "nowhere", "type": "CALLS", "status": "added"}]
STUB = """
const els={};function el(id){return {id,children:[],textContent:id==='data'?DATA:'',value:'',checked:true,clientWidth:300,clientHeight:200,append(...x){this.children.push(...x)},replaceChildren(...x){this.children=x},
 getContext(){return new Proxy({},{get:(t,k)=>k in t?t[k]:()=>{},set:(t,k,v)=>{t[k]=v;return true}})}}}
globalThis.document={getElementById:i=>els[i]||(els[i]=el(i)),createElement:t=>el(t)};
let frames=0;globalThis.requestAnimationFrame=f=>{if(frames++<5)f()};
"""
USE = """
const say={};els.q.value='alp';els.q.oninput();say.found=els.r.children.length;els.r.children[0].onclick();
say.out=els.d.children[1].children.length-1;say.into=els.d.children[2].children.length-1;say.filters=els.f.children.map(l=>l.children[1]).sort();
const box=els.f.children.find(l=>l.children[1]==='added').children[0];box.checked=false;box.onchange();els.q.oninput();say.hidden=els.r.children.length;
say.drawn=nodes.every(n=>Number.isFinite(n.x)&&Number.isFinite(n.y));console.log(JSON.stringify(say));
"""


def parts():
    page = export.page({"nodes": NODES, "links": LINKS}, "A & <b>", "2 symbols")
    assert "<title>A &amp; &lt;b&gt;</title>" in page and page.count("</script>") == 2
    at = page.index('type="application/json">') + 24
    return page[at : page.index("</script>", at)], page[page.rindex("<script>") + 8 : page.rindex("</script>")]


def test_data_is_whole():
    assert json.loads(parts()[0]) == {"nodes": NODES, "links": LINKS}


def test_viewer(tmp_path):
    if not shutil.which("node"):
        pytest.skip("no Node here")
    data, script = parts()
    (tmp_path / "v.js").write_text(f"const DATA={json.dumps(data)};{STUB}{script}{USE}")
    said = subprocess.run(["node", str(tmp_path / "v.js")], capture_output=True, text=True, timeout=60, check=True).stdout
    assert json.loads(said) == {"found": 1, "out": 1, "into": 0, "filters": ["Class", "Function", "added", "removed"], "hidden": 0, "drawn": True}

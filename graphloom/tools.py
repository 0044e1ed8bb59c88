"""The sixteen tools by name, and a JSON-RPC dispatcher over them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import KG
from graphloom.operators import analyze as A
from graphloom.operators import build, embed, export, iterate, search
from graphloom.operators import traverse as T


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


class Tools:
    """``call(name, **arguments)`` over one graph; ``index`` is for semantic questions."""

    def __init__(self, kg: KG, index: DataFrame | None = None, encoder=None, other: KG | None = None) -> None:
        self.kg, self.index, self.encoder, self.other = kg, index, encoder, other

    def query_graph(self, question: str, budget: int = 2000) -> dict:
        terms = search.question_terms(question)
        lexical = [r["id"] for r in search.lexical_seeds(self.kg, terms).collect()]
        warning, more = None, []
        try:
            if self.index is not None:
                more = [r["node_id"] for r in search.semantic_seeds(self.kg, self._matches(question, 8), question, terms).collect()]
        except ValueError as e:
            warning = str(e)
        seeds = list(dict.fromkeys([*lexical, *more]))[:8]
        context = T.bounded_context(self.kg, seeds, search.query_scores(self.kg, terms).select("id", "score"), budget)
        return {"seeds": seeds, **context, **({"warning": warning} if warning else {})}

    def query(self, question: str, depth_first: bool = False, budget: int = 2000, depth: int = 2) -> str:
        """A question's best nodes and what lies around them as text, breadth or depth first.

        Starts are the five best by meaning if there is an index that knows any, else the five best by words.
        """
        starts = [] if self.index is None or self.encoder is None else [r["node_id"] for r in self._matches(question, 5).collect()]
        if not starts:
            terms = [w.lower() for w in question.split() if len(w.encode()) > 2]
            starts = [r["id"] for r in search.score_nodes(self.kg, terms, 5).collect()]
        if not starts:
            return "No matching nodes found."
        if depth_first:
            return T.visited_text(self.kg, T.dfs_tree(self.kg, starts, depth), depth, ("place",), budget)
        return T.visited_text(self.kg, T.bfs(self.kg, starts, depth), depth, ("depth",), budget)

    def _matches(self, question: str, top_n: int) -> DataFrame:
        if self.index is None or self.encoder is None:
            raise ValueError("no semantic index: build one with operators.search.index_text and operators.embed.encode_text")
        return search.hybrid(self.kg, self.index, question, self.encoder(question), top_n)

    def semantic_query(self, question: str, top_n: int = 8) -> list[dict]:
        return _rows(self._matches(question, top_n))

    def get_node(self, node_id: str) -> list[dict]:
        return _rows(A.get_node(self.kg, node_id))

    def get_neighbors(self, node_id: str, depth: int = 1) -> list[dict]:
        return _rows(T.neighbors(self.kg, node_id, depth).orderBy("depth", "id"))

    def get_community(self, community: int) -> list[dict]:
        return _rows(A.get_community(self.kg, community))

    def god_nodes(self, top_n: int = 10) -> list[dict]:
        return _rows(A.god_nodes(self.kg, top_n))

    def graph_stats(self) -> list[dict]:
        return _rows(A.graph_stats(self.kg))

    def shortest_path(self, source: str, target: str) -> list[str] | None:
        return T.shortest_path(self.kg, source, target)

    def find_all_paths(self, source: str, target: str, max_length: int = 4) -> list[dict]:
        return _rows(T.simple_paths(self.kg, source, target, max_length))

    def weighted_path(self, source: str, target: str, min_confidence: float = 0.0) -> dict | None:
        found = T.weighted_path(self.kg, source, target, min_confidence)
        return None if found is None else {"total": found[0], "path": found[1]}

    def community_bridges(self, top_n: int = 10) -> list[dict]:
        return _rows(A.community_bridges(self.kg, top_n))

    def graph_diff(self) -> list[dict]:
        if self.other is None:
            raise ValueError("no second graph")
        return _rows(build.diff(self.other, self.kg))

    def pagerank(self, top_n: int = 10) -> list[dict]:
        return _rows(iterate.pagerank(self.kg).join(self.kg.nodes.select("id", "label"), "id").orderBy(F.desc("score"), "id").limit(top_n))

    def detect_cycles(self, max_cycles: int = 10) -> list[dict]:
        return _rows(iterate.cycles(self.kg, max_cycles))

    def smart_summary(self, level: str = "community", top_n: int = 20) -> list[dict]:
        if level == "architecture":
            return _rows(A.architecture_summary(self.kg).orderBy(F.desc("n"), "dir").limit(30))
        if level == "detailed":
            return _rows(self.kg.edges.select("source", "relation", "target").orderBy("source", "target", "relation").limit(top_n))
        return _rows(A.community_summary(self.kg).orderBy(F.desc("size"), "community").limit(top_n))

    def find_similar(self, top_n: int = 10) -> list[dict]:
        """Of vectors trained for all nodes."""
        return _rows(embed.similar_pairs(embed.node_vectors(self.kg), top_n=top_n))

    NAMES = (
        "query_graph", "semantic_query", "get_node", "get_neighbors", "get_community", "god_nodes", "graph_stats", "shortest_path", "find_all_paths", "weighted_path",
        "community_bridges", "graph_diff", "pagerank", "detect_cycles", "smart_summary", "find_similar",
    )

    def call(self, name: str, **arguments):
        if name not in self.NAMES:
            raise KeyError(name)
        return getattr(self, name)(**arguments)


def handle(tools: Tools, line: str, form: str = "json") -> str | None:
    """One JSON-RPC request, or a batch of them; notifications have no answer."""

    def error(id_, code: int, message: str) -> dict:
        return {"jsonrpc": "2.0", "id": id_, "error": {"code": code, "message": message}}

    def one(r: dict) -> dict | None:
        method, params, id_ = r.get("method"), r.get("params") or {}, r.get("id")
        if method == "notifications/initialized":
            return None
        if method == "initialize":
            result = {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "graphloom", "version": "0.1.0"}}
        elif method == "ping":
            result = {}
        elif method == "tools/list":
            result = {"tools": [{"name": n} for n in Tools.NAMES]}
        elif method == "tools/call":
            try:
                result = {"content": [{"type": "text", "text": export.render(tools.call(params.get("name"), **params.get("arguments", {})), form)}]}
            except (KeyError, TypeError, ValueError) as e:
                result = {"content": [{"type": "text", "text": str(e)}], "isError": True}
        else:
            return error(id_, -32601, f"unknown method: {method}")
        return {"jsonrpc": "2.0", "id": id_, "result": result}

    try:
        request = json.loads(line)
    except ValueError:
        return json.dumps(error(None, -32700, "parse error"))
    answers = [a for a in map(one, request if isinstance(request, list) else [request]) if a is not None]
    if not answers:
        return None
    return json.dumps(answers if isinstance(request, list) else answers[0], default=str)

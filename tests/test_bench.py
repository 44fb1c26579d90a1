"""The bench names what its total omits."""

import ast
import pathlib


def test_omitted_queries_are_named():
    source = pathlib.Path(__file__).parents[1].joinpath("bench.py").read_text()
    keys = {k.value for n in ast.walk(ast.parse(source)) if isinstance(n, ast.Dict) for k in n.keys if isinstance(k, ast.Constant)}
    assert "omitted" in keys

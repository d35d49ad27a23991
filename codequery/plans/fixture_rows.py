"""A small code base and, by query, the rows that the engine must give for it (columns, rows)."""

FILES = {
    "README.md": "# Shop\n",
    "docs/README.md": "not at the root\n",
    "app/models.py": '"""Models."""\nimport os.path\nfrom sqlalchemy import Column\n\n__all__ = ["Item", "Box"]\n\n\nclass Item(Base):\n    """An item."""\n\n    def save(self):\n        return self.check() or store(self)\n\n    async def check(self):\n        return True\n\n\nclass Box(Generic[Item], declarative_base()):\n    pass\n',
    "app/api.py": 'import flask\nfrom app.models import Item\n\n\n@app.GET("/items")\ndef list_items(limit: int = 10) -> list:\n    out = [load()]\n    for x in range(limit):\n        if x and limit or out:\n            out.append(load())\n    return save_all(out)\n\n\ndef load():\n    return eval("1")\n\n\ndef load():\n    return (lambda: 2)()\n',
    "web/cart.js": "import { price } from './price';\nimport ext from 'react';\nexport function total(items) {\n  function one(i) { return price(i) + total([]); }\n  return items.map(i => one(i));\n}\nclass Cart {\n  sum() { return this.all(); }\n  all() { return total([]); }\n}\n",
    "web/price.ts": "export const price = (item: { cents: number }): number => round(item.cents);\nfunction round(n: number): number { return n; }\nexport interface Item { cents: number }\n",
    "web/bad.js": "function ok() { return other(); }\nfunction broken( {\n",
    "web/only.js": "go();\n",
    "web/lib.min.js": "x",
    "node_modules/a.js": "x",
    "conf/app.yaml": "a: 1\n" * 5000 + 'password = "longenough"\n',
    "app/broken.py": "def (\n",
}
CHANGED = {"app/api.py": FILES["app/api.py"].replace('eval("1")', "1"), "web/new.ts": "export enum Kind { A }\n"}
ROWS: dict[str, tuple[tuple[str, ...], list[tuple]]] = {
    "py_units": (
        ('path', 'unit_type', 'qualified_name', 'name', 'line_start', 'line_end', 'complexity', 'status', 'bases', 'routes'),
        [
            ('app/api.py', 'file', 'app/api.py', 'api', 1, 19, 1, 'ok', [], []),
            ('app/api.py', 'function', 'list_items', 'list_items', 5, 11, 5, 'ok', [], ['GET /items']),
            ('app/api.py', 'function', 'load', 'load', 14, 15, 1, 'ok', [], []),
            ('app/api.py', 'function', 'load', 'load', 18, 19, 1, 'ok', [], []),
            ('app/broken.py', 'file', 'app/broken.py', 'app/broken.py', 1, 1, 1, 'failed', [], []),
            ('app/models.py', 'class', 'Box', 'Box', 18, 19, 1, 'ok', ['Generic[Item]', 'declarative_base()'], []),
            ('app/models.py', 'class', 'Item', 'Item', 8, 15, 1, 'ok', ['Base'], []),
            ('app/models.py', 'file', 'app/models.py', 'models', 1, 19, 1, 'ok', [], []),
            ('app/models.py', 'method', 'Item.check', 'check', 14, 15, 1, 'ok', [], []),
            ('app/models.py', 'method', 'Item.save', 'save', 11, 12, 2, 'ok', [], []),
        ],
    ),
    "file_scan": (
        ('path', 'language', 'reason'),
        [
            ('app/api.py', 'Python', None),
            ('app/broken.py', 'Python', None),
            ('app/models.py', 'Python', None),
            ('web/bad.js', 'JavaScript', None),
            ('web/cart.js', 'JavaScript', None),
            ('web/lib.min.js', 'JavaScript', 'generated_bundle'),
            ('web/only.js', 'JavaScript', None),
            ('web/price.ts', 'TypeScript', None),
        ],
    ),
    "py_calls": (
        ('qualified_name', 'sites', 'uncertainty'),
        [
            ('Item.save', ['self.check@12', 'store@12'], []),
            ('list_items', ['app.GET@5', 'load@7', 'range@8', 'out.append@10', 'load@10', 'save_all@11'], []),
            ('load', ['eval@15'], []),
        ],
    ),
    "unit_imports": (
        ('path', 'imports', 'exports'),
        [
            ('app/api.py', ['app.models', 'flask'], ['list_items', 'load', 'load']),
            ('app/broken.py', [], []),
            ('app/models.py', ['os.path', 'sqlalchemy'], ['Box', 'Item']),
            ('web/bad.js', [], []),
            ('web/cart.js', ['./price', 'react'], ['total']),
            ('web/only.js', [], []),
            ('web/price.ts', [], ['Item', 'price']),
        ],
    ),
    "retrieval_units": (
        ('path', 'unit_type', 'qualified_name'),
        [
            ('app/api.py', 'function', 'list_items'),
            ('app/api.py', 'function', 'load'),
            ('app/api.py', 'function', 'load'),
            ('app/models.py', 'class', 'Box'),
            ('app/models.py', 'class', 'Item'),
            ('app/models.py', 'method', 'Item.check'),
            ('app/models.py', 'method', 'Item.save'),
            ('web/bad.js', 'function', 'ok'),
            ('web/cart.js', 'class', 'Cart'),
            ('web/cart.js', 'function', 'total'),
            ('web/cart.js', 'function', 'total.one'),
            ('web/cart.js', 'method', 'Cart.all'),
            ('web/cart.js', 'method', 'Cart.sum'),
            ('web/only.js', 'file', 'web/only.js'),
            ('web/price.ts', 'function', 'price'),
            ('web/price.ts', 'function', 'round'),
            ('web/price.ts', 'type', 'Item'),
        ],
    ),
    "document_text": (
        ('qualified_name', 'line_start', 'document'),
        [
            ('Item.check', 14, 'Python method Item.check|file: app/models.py|async def check(self)|    async def check(self):|        return True'),
            ('load', 14, 'Python function load|file: app/api.py|def load()|def load():|    return eval("1")'),
            ('load', 18, 'Python function load|file: app/api.py|def load()|def load():|    return (lambda: 2)()'),
            ('price', 1, 'TypeScript function price|file: web/price.ts|export const price = (item: { cents: number }): number|export const price = (item: { cents: number }): number => round(item.cents);'),
        ],
    ),
    "weighted_terms": (
        ('term', 'tf'),
        [
            ('app', 2),
            ('check', 9),
            ('item', 3),
            ('model', 2),
            ('os', 1),
            ('path', 1),
            ('py', 2),
            ('sqlalchemy', 1),
            ('true', 1),
        ],
    ),
    "coverage": (
        ('seen', 'parsed', 'partial', 'failed', 'skipped', 'units', 'ratio', 'languages', 'reasons'),
        [
            (8, 5, 1, 1, 1, 16, 0.8571, ['JavaScript 3', 'Python 3', 'TypeScript 1'], ['generated_bundle']),
        ],
    ),
    "readme_documents": (
        ('path', 'text'),
        [
            ('README.md', '# Shop\n'),
        ],
    ),
    "verify_source": (
        ('path', 'qualified_name', 'line_start', 'status'),
        [
            ('../cart.js', 'outside', 3, 'invalid'),
            ('app/api.py', 'list_items', 5, 'verified'),
            ('app/api.py', 'load', 14, 'stale'),
            ('app/api.py', 'load', 18, 'verified'),
            ('web/cart.js', 'Cart', 7, 'verified'),
            ('web/cart.js', 'Cart.all', 9, 'verified'),
            ('web/cart.js', 'Cart.sum', 8, 'verified'),
            ('web/cart.js', 'total', 3, 'verified'),
            ('web/cart.js', 'total.one', 4, 'verified'),
            ('web/price.ts', 'Item', 3, 'missing'),
            ('web/price.ts', 'price', 1, 'missing'),
            ('web/price.ts', 'round', 2, 'missing'),
        ],
    ),
    "container_edges": (
        ('source', 'target', 'kind'),
        [
            ('Cart', 'Cart.all', 'CONTAINS'),
            ('Cart', 'Cart.sum', 'CONTAINS'),
            ('Item', 'Item.check', 'CONTAINS'),
            ('Item', 'Item.save', 'CONTAINS'),
            ('app/api.py', 'list_items', 'DEFINES'),
            ('app/api.py', 'load', 'DEFINES'),
            ('app/api.py', 'load', 'DEFINES'),
            ('app/models.py', 'Box', 'DEFINES'),
            ('app/models.py', 'Item', 'DEFINES'),
            ('total', 'total.one', 'CONTAINS'),
            ('web/bad.js', 'ok', 'DEFINES'),
            ('web/cart.js', 'Cart', 'DEFINES'),
            ('web/cart.js', 'total', 'DEFINES'),
            ('web/price.ts', 'Item', 'DEFINES'),
            ('web/price.ts', 'price', 'DEFINES'),
            ('web/price.ts', 'round', 'DEFINES'),
        ],
    ),
    "export_edges": (
        ('source', 'target', 'kind'),
        [
            ('app/api.py', 'list_items', 'EXPORTS'),
            ('app/api.py', 'load', 'EXPORTS'),
            ('app/api.py', 'load', 'EXPORTS'),
            ('app/models.py', 'Box', 'EXPORTS'),
            ('app/models.py', 'Item', 'EXPORTS'),
            ('web/cart.js', 'total', 'EXPORTS'),
            ('web/price.ts', 'Item', 'EXPORTS'),
            ('web/price.ts', 'price', 'EXPORTS'),
        ],
    ),
    "import_targets": (
        ('path', 'spec', 'target'),
        [
            ('app/api.py', 'app.models', 'app/models.py'),
            ('app/api.py', 'flask', None),
            ('app/models.py', 'os.path', None),
            ('app/models.py', 'sqlalchemy', None),
            ('web/cart.js', './price', 'web/price.ts'),
            ('web/cart.js', 'react', None),
        ],
    ),
    "import_edges": (
        ('source', 'target', 'kind'),
        [
            ('app/api.py', 'app/models.py', 'IMPORTS'),
            ('web/cart.js', 'web/price.ts', 'IMPORTS'),
        ],
    ),
    "call_edges": (
        ('source', 'target', 'resolution', 'line'),
        [
            ('Cart.all', 'total', 'same_file', 9),
            ('Cart.sum', 'Cart.all', 'this_method', 8),
            ('list_items', 'load', 'same_file', 10),
            ('list_items', 'load', 'same_file', 7),
            ('price', 'round', 'same_file', 1),
            ('total', 'total.one', 'nested_scope', 5),
            ('total.one', 'price', 'import_export', 4),
            ('total.one', 'total', 'same_file', 4),
        ],
    ),
    "call_unresolved": (
        ('qualified_name', 'name', 'line', 'reason'),
        [
            ('Item.save', 'self.check', 12, 'dynamic receiver'),
            ('Item.save', 'store', 12, 'external or unknown symbol'),
            ('list_items', 'app.GET', 5, 'dynamic receiver'),
            ('list_items', 'out.append', 10, 'dynamic receiver'),
            ('list_items', 'range', 8, 'external or unknown symbol'),
            ('list_items', 'save_all', 11, 'external or unknown symbol'),
            ('load', 'eval', 15, 'external or unknown symbol'),
            ('ok', 'other', 1, 'external or unknown symbol'),
            ('total', 'items.map', 5, 'dynamic receiver'),
        ],
    ),
    "code_edges": (
        ('kind', 'resolution', 'n'),
        [
            ('CALLS', 'import_export', 1),
            ('CALLS', 'nested_scope', 1),
            ('CALLS', 'same_file', 5),
            ('CALLS', 'this_method', 1),
            ('CONTAINS', 'syntax', 5),
            ('DEFINES', 'syntax', 11),
            ('EXPORTS', 'syntax', 8),
            ('IMPORTS', 'module_path', 2),
        ],
    ),
    "call_order": (
        ('asked', 'qualified_name', 'observed_order', 'score'),
        [
            ('append load', 'list_items', 'after', 0.5),
            ('load append', 'list_items', 'before', 1.0),
            ('load load', 'list_items', 'after', 0.5),
            ('save_all range', 'list_items', 'after', 0.5),
        ],
    ),
    "kg_nodes": (
        ('kind', 'name'),
        [
            ('API_ENDPOINT', 'GET /items'),
            ('CLASS', 'Box'),
            ('CLASS', 'Cart'),
            ('CLASS', 'Item'),
            ('DATABASE_ENTITY', 'Item'),
            ('FILE', 'app/api.py'),
            ('FILE', 'app/broken.py'),
            ('FILE', 'app/models.py'),
            ('FILE', 'web/bad.js'),
            ('FILE', 'web/cart.js'),
            ('FILE', 'web/only.js'),
            ('FILE', 'web/price.ts'),
            ('FUNCTION', 'Cart.all'),
            ('FUNCTION', 'Cart.sum'),
            ('FUNCTION', 'Item.check'),
            ('FUNCTION', 'Item.save'),
            ('FUNCTION', 'list_items'),
            ('FUNCTION', 'load'),
            ('FUNCTION', 'load'),
            ('FUNCTION', 'ok'),
            ('FUNCTION', 'price'),
            ('FUNCTION', 'round'),
            ('FUNCTION', 'total'),
            ('FUNCTION', 'total.one'),
            ('LIBRARY', 'app'),
            ('LIBRARY', 'flask'),
            ('LIBRARY', 'os'),
            ('LIBRARY', 'react'),
            ('LIBRARY', 'sqlalchemy'),
            ('REPOSITORY', 'r'),
        ],
    ),
    "kg_edges": (
        ('kind', 'source', 'target'),
        [
            ('CALLS', 'FUNCTION:Cart.all', 'FUNCTION:total'),
            ('CALLS', 'FUNCTION:Cart.sum', 'FUNCTION:Cart.all'),
            ('CALLS', 'FUNCTION:list_items', 'FUNCTION:load'),
            ('CALLS', 'FUNCTION:price', 'FUNCTION:round'),
            ('CALLS', 'FUNCTION:total', 'FUNCTION:total.one'),
            ('CALLS', 'FUNCTION:total.one', 'FUNCTION:price'),
            ('CALLS', 'FUNCTION:total.one', 'FUNCTION:total'),
            ('CONTAINS', 'CLASS:Cart', 'FUNCTION:Cart.all'),
            ('CONTAINS', 'CLASS:Cart', 'FUNCTION:Cart.sum'),
            ('CONTAINS', 'CLASS:Item', 'FUNCTION:Item.check'),
            ('CONTAINS', 'CLASS:Item', 'FUNCTION:Item.save'),
            ('CONTAINS', 'REPOSITORY:r', 'FILE:app/api.py'),
            ('CONTAINS', 'REPOSITORY:r', 'FILE:app/broken.py'),
            ('CONTAINS', 'REPOSITORY:r', 'FILE:app/models.py'),
            ('CONTAINS', 'REPOSITORY:r', 'FILE:web/bad.js'),
            ('CONTAINS', 'REPOSITORY:r', 'FILE:web/cart.js'),
            ('CONTAINS', 'REPOSITORY:r', 'FILE:web/only.js'),
            ('CONTAINS', 'REPOSITORY:r', 'FILE:web/price.ts'),
            ('DEFINES', 'FILE:app/api.py', 'FUNCTION:list_items'),
            ('DEFINES', 'FILE:app/api.py', 'FUNCTION:load'),
            ('DEFINES', 'FILE:app/api.py', 'FUNCTION:load'),
            ('DEFINES', 'FILE:app/models.py', 'CLASS:Box'),
            ('DEFINES', 'FILE:app/models.py', 'CLASS:Item'),
            ('DEFINES', 'FILE:web/bad.js', 'FUNCTION:ok'),
            ('DEFINES', 'FILE:web/cart.js', 'CLASS:Cart'),
            ('DEFINES', 'FILE:web/cart.js', 'FUNCTION:total'),
            ('DEFINES', 'FILE:web/cart.js', 'FUNCTION:total.one'),
            ('DEFINES', 'FILE:web/price.ts', 'FUNCTION:price'),
            ('DEFINES', 'FILE:web/price.ts', 'FUNCTION:round'),
            ('EXPOSES', 'FUNCTION:list_items', 'API_ENDPOINT:GET /items'),
            ('IMPORTS', 'FILE:app/api.py', 'LIBRARY:app'),
            ('IMPORTS', 'FILE:app/api.py', 'LIBRARY:flask'),
            ('IMPORTS', 'FILE:app/models.py', 'LIBRARY:os'),
            ('IMPORTS', 'FILE:app/models.py', 'LIBRARY:sqlalchemy'),
            ('IMPORTS', 'FILE:web/cart.js', 'LIBRARY:react'),
            ('USES', 'CLASS:Item', 'DATABASE_ENTITY:Item'),
        ],
    ),
    "node_search": (
        ('asked', 'kind', 'name'),
        [
            ('any', 'FUNCTION', 'load'),
            ('any', 'FUNCTION', 'load'),
            ('class', 'CLASS', 'Item'),
        ],
    ),
    "subgraph_export": (
        ('name', 'linked'),
        [
            ('app/api.py', True),
            ('app/broken.py', True),
            ('app/models.py', True),
            ('r', False),
            ('web/bad.js', True),
            ('web/cart.js', True),
            ('web/only.js', True),
            ('web/price.ts', True),
        ],
    ),
    "graph_question": (
        ('kind', 'name', 'hop'),
        [
            ('API_ENDPOINT', 'GET /items', 1),
            ('FUNCTION', 'list_items', 0),
            ('FUNCTION', 'load', 1),
        ],
    ),
    "latest_version": (
        ('repository_id', 'versions', 'latest'),
        [
            ('r', 2, 'c2'),
        ],
    ),
    "version_scope": (
        ('commit_sha', 'units', 'ids'),
        [
            ('c1', 4, 8),
            ('c2', 4, 8),
        ],
    ),
    "search_results": (
        ('rank', 'qualified_name', 'evidence', 'lists', 'excerpt_line_end', 'excerpt_truncated'),
        [
            (1, 'load', ['lexical', 'semantic'], 2, 15, False),
            (2, 'load', ['lexical', 'semantic'], 2, 19, False),
            (3, 'list_items', ['lexical', 'semantic'], 2, 11, False),
        ],
    ),
    "search_modes": (
        ('mode', 'rank', 'qualified_name', 'evidence'),
        [
            ('hybrid', 1, 'total', ['lexical', 'semantic']),
            ('hybrid_rerank', 1, 'total', ['reranker']),
            ('lexical', 1, 'total', ['lexical']),
        ],
    ),
    "adaptive_trace": (
        ('question', 'actions', 'reason', 'iterations', 'tool_calls'),
        [
            ('save item', ['lexical', 'semantic', 'fuse', 'stop'], 'rules_exhausted', 1, 3),
            ('what calls load before append?', ['lexical', 'semantic', 'fuse', 'structural_order', 'stop'], 'structural_answer', 2, 4),
            ('what calls load before nothing?', ['lexical', 'semantic', 'fuse', 'structural_order', 'stop'], 'no_structural_match', 2, 4),
            ('who calls load', ['lexical', 'semantic', 'fuse', 'expand_relationships', 'query_rewrite', 'fuse', 'stop'], 'no_new_evidence: rewrite only re-ranked existing candidates', 3, 6),
            ('zebra total', ['lexical', 'semantic', 'fuse', 'stop'], 'sufficient_evidence: lexical and semantic agree on the top unit', 1, 3),
        ],
    ),
    "adaptive_budgets": (
        ('budget', 'reason', 'ranked'),
        [
            ('candidates', '', 2),
            ('iterations', 'iteration_budget', 3),
            ('time', 'timeout', 3),
            ('tools', 'tool_call_budget', 3),
        ],
    ),
    "adaptive_links": (
        ('qualified_name', 'types', 'evidence'),
        [
            ('list_items', ['CALL_ORDER', 'UNRESOLVED_CALLS'], ['lexical', 'semantic', 'graph']),
        ],
    ),
    "callers": (
        ('side', 'qualified_name'),
        [
            ('callee', 'total.one'),
            ('caller', 'Cart.all'),
            ('caller', 'total.one'),
        ],
    ),
    "engine_impact": (
        ('way', 'qualified_name', 'hop'),
        [
            ('reached by', 'Cart', 4),
            ('reached by', 'Cart.all', 3),
            ('reached by', 'Cart.sum', 4),
            ('reached by', 'price', 0),
            ('reached by', 'total', 2),
            ('reached by', 'total.one', 1),
            ('reached by', 'web/cart.js', 2),
            ('reached by', 'web/price.ts', 1),
            ('reaches', 'price', 2),
            ('reaches', 'round', 3),
            ('reaches', 'total', 0),
            ('reaches', 'total.one', 1),
        ],
    ),
    "code_findings": (
        ('path', 'line', 'rule_id', 'severity'),
        [
            ('app/api.py', 15, 'R002', 'HIGH'),
            ('conf/app.yaml', 5001, 'R004', 'CRITICAL'),
        ],
    ),
    "engine_risks": (
        ('qualified_name', 'risk', 'reasons'),
        [
            ('Cart.all', 15.0, ['low observed structural and evolution risk']),
            ('Cart.sum', 15.0, ['low observed structural and evolution risk']),
            ('Item.check', 4.0, ['low observed structural and evolution risk']),
            ('Item.save', 14.0, ['low observed structural and evolution risk']),
            ('list_items', 55.0, ['frequently modified', 'multiple contributors']),
            ('load', 24.0, ['frequently modified', 'multiple contributors']),
            ('load', 49.0, ['frequently modified', 'multiple contributors', 'security finding in function']),
            ('ok', 7.0, ['low observed structural and evolution risk']),
            ('price', 7.0, ['low observed structural and evolution risk']),
            ('round', 4.0, ['low observed structural and evolution risk']),
            ('total', 18.0, ['low observed structural and evolution risk']),
            ('total.one', 18.0, ['low observed structural and evolution risk']),
        ],
    ),
    "engine_summary": (
        ('architecture', 'dependencies', 'risk', 'seen', 'failed', 'skipped', 'units'),
        [
            ('JavaScript front-end application', ['', 'app', 'flask', 'os', 'react', 'sqlalchemy'], 19.2, 8, 1, 1, 16),
        ],
    ),
    "engine_warnings": (
        ('warning',),
        [
            ('1 file(s) skipped: {"generated_bundle":1}',),
            ('partial parse coverage: 1 failed and 1 partially parsed file(s)',),
        ],
    ),
    "unresolved_notes": (
        ('qualified_name', 'n', 'examples'),
        [
            ('Item.save', 2, ['self.check', 'store']),
            ('list_items', 4, ['app.GET', 'range', 'out.append']),
            ('load', 1, ['eval']),
            ('ok', 1, ['other']),
            ('total', 1, ['items.map']),
        ],
    ),
    "repository_risks": (
        ('known', 'risk'),
        [
            ('findings', 30.0),
            ('many findings', 100.0),
            ('mean', 17.6),
            ('nothing', 0.0),
        ],
    ),
    "secret_texts": (
        ('id', 'patterns', 'kept', 'nul_at'),
        [
            (1, ['0'], 12000, 0),
            (2, ['2'], 12000, 0),
            (3, ['0', '1'], 12000, 0),
            (4, [], 12000, 0),
            (5, [], 12000, 0),
        ],
    ),
    "arch_label": (
        ('repo', 'architecture'),
        [
            ('a', 'JavaScript web service / API'),
            ('b', 'JavaScript front-end application'),
            ('c', 'modular TypeScript application'),
            ('d', 'modular JavaScript application'),
            ('e', 'web service / API'),
            ('f', 'data-backed application'),
            ('g', 'command-line application'),
            ('h', 'modular Python application'),
            ('i', 'modular Python application'),
        ],
    ),
    "deps": (
        ('root',),
        [
            ('',),
            ('app',),
            ('flask',),
            ('os',),
            ('react',),
            ('sqlalchemy',),
        ],
    ),
    "display_names": (
        ('source', 'name'),
        [
            ('/home/a/shop/', 'shop'),
            ('git@h.org:shop.git', 'shop'),
            ('git@h.org:team/shop', 'shop'),
            ('https://h.org/team/shop.git', 'shop'),
        ],
    ),
    "source_checks": (
        ('place', 'accepted'),
        [
            (' ', None),
            ('/srv/code', '/srv/code'),
            ('ftp://h.org/a', None),
            ('git@h.org:a', 'git@h.org:a'),
            ('https://h.org/a.git', 'https://h.org/a.git'),
            ('https://u:p@h.org/a', None),
        ],
    ),
    "label_units": (
        ('query', 'label', 'n_units'),
        [
            ('q1', 'Item.check', 1),
            ('q2', 'app/api.py::load', 2),
            ('q3', 'web/price.ts::load', 0),
            ('q4', 'nothing', 0),
        ],
    ),
    "mode_report": (
        ('mode', 'rr', 'recall_1', 'latency_p50', 'latency_p95', 'misses_at_1', 'span_validity'),
        [
            ('hybrid', 0.6111, 0.3333, 20.0, 30.0, ['b', 'c'], 0.6667),
            ('lexical', 0.25, 0.0, 7.0, 7.0, ['a'], 1.0),
        ],
    ),
    "index_stats": (
        ('all_units', 'retrievable_units'),
        [
            (24, 17),
        ],
    ),
    "planned_tools": (
        ('question', 'tools', 'symbol'),
        [
            ('Explain the authentication flow', ['search_code', 'query_repository_graph'], None),
            ('hello', ['search_code'], None),
            ('is parse_date a security risk', ['security_scan'], 'parse_date'),
            ('what breaks if validate_token changes?', ['search_code', 'query_repository_graph', 'impact_analysis', 'analyze_function', 'security_scan'], 'validate_token'),
        ],
    ),
    "planner_loop": (
        ('question', 'done', 'ok', 'notes', 'confidence'),
        [
            ('call of check_password', ['search_code', 'query_repository_graph', 'security_scan'], [True, False, True], 1, 0.75),
            ('plain words', ['search_code'], [True], 1, 0.75),
        ],
    ),
    "json_round_trip": (
        ('text', 'label'),
        [
            ('a "b"', 1),
            ('a', 9),
            ('b::c', 9),
            ('who?', 0),
            ('ünï', None),
        ],
    ),
}

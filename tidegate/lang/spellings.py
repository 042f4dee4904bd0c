"""JSON and YAML spellings of rule files.

JSON: arrays are calls, objects are options, ``"$name"`` is a binding and other texts are texts;
``{"str": ..}``, ``{"sym": ..}``, ``{"kw": ..}`` and ``{"vector": [..]}`` say what else is meant.
YAML: ``on`` and ``every`` are lists of rule maps; in rule bodies unquoted words must be
numbers, booleans, nil, ``$`` bindings, option words or the first item of an array.
"""

from __future__ import annotations

import json

from tidegate.lang.tree import Call, Key, RuleFileError, Sym, Vec

#: Names a rule body can use, and words that are options in YAML.
BINDINGS = ("subject", "payload", "payload-float", "payload-int", "payload-bool", "replaying?", "reply-to")
OPTION_WORDS = ("ms", "dp", "subject", "leaf", "lost", "found", "avg", "sum", "min", "max", "count", "rate", "date", "hour", "minute", "reentrant")


def binding(name: str) -> Sym:
    full = "replaying?" if name == "replaying" else name
    if full not in BINDINGS:
        raise RuleFileError(f"unknown binding ${name}; known: {', '.join('$' + b for b in BINDINGS)}")
    return Sym(full)


# ---------------------------------------------------------------- JSON


def from_json(source: str) -> list:
    try:
        doc = json.loads(source, parse_int=float, parse_float=float)
    except ValueError as e:
        raise RuleFileError(f"not JSON: {e}") from None
    if not isinstance(doc, list):
        raise RuleFileError("a JSON rule file is an array of forms")
    return [_json_call(x) for x in doc]


def _json_call(x) -> Call:
    if not isinstance(x, list) or not x or not isinstance(x[0], str):
        raise RuleFileError("a form is an array that begins with its name")
    args: list = []
    for item in x[1:]:
        args.extend(_json_args(item))
    return Call(x[0], tuple(args))


def _json_args(x) -> list:
    """An argument; an object of options makes several."""
    if isinstance(x, dict):
        if len(x) == 1:
            (name, value), = x.items()
            if name == "str" and isinstance(value, str):
                return [value]
            if name == "sym" and isinstance(value, str):
                return [Sym(value)]
            if name == "kw" and isinstance(value, str):
                return [Key(value.lstrip(":"))]
            if name == "vector" and isinstance(value, list):
                return [Vec(tuple(a for v in value for a in _json_args(v)))]
        if "vec" in x:
            raise RuleFileError('write {"vector": [..]}, not {"vec": [..]}')
        out: list = []
        for name, value in x.items():
            out.append(Key(name.lstrip(":")))
            if not (name == "leaf" and value is True):
                out.extend(_json_args(value))
        return out
    if isinstance(x, list):
        return [_json_call(x)]
    if isinstance(x, str) and x.startswith("$") and not x.startswith(("$LVC.", "$STATS.")):
        return [binding(x[1:])]
    return [x]


# ---------------------------------------------------------------- YAML


def from_yaml(source: str) -> list:
    import yaml

    if "\t" in "".join(line[: len(line) - len(line.lstrip())] for line in source.splitlines()):
        raise RuleFileError("tabs can't indent YAML")
    try:
        root = yaml.compose(source, Loader=yaml.SafeLoader)
    except yaml.YAMLError as e:
        raise RuleFileError(f"not YAML: {e}") from None
    if root is None:
        return []
    forms: list = []
    for key, value in _pairs(root, "the document"):
        if key in ("on", "every"):
            forms += [_yaml_rule(key, item) for item in _items(value, key)]
        elif key == "lvc":
            forms.append(Call("lvc", tuple(_plain(v) for v in (_items(value, key) if _is_list(value) else [value]))))
        elif key in ("export", "bridge", "import"):
            args: list = []
            for name, v in _pairs(value, key):
                args += [Key(name), _config(v)]
            forms.append(Call(key, tuple(args)))
        else:
            raise RuleFileError(f"unknown top-level key {key}")
    return forms


def _is_list(node) -> bool:
    return type(node).__name__ == "SequenceNode"


def _pairs(node, where: str) -> list[tuple[str, object]]:
    if type(node).__name__ != "MappingNode":
        raise RuleFileError(f"{where} must be a map")
    out: list[tuple[str, object]] = []
    for k, v in node.value:
        if any(k.value == name for name, _ in out):
            raise RuleFileError(f"{where} has {k.value} twice")
        out.append((k.value, v))
    return out


def _items(node, where: str) -> list:
    if not _is_list(node):
        raise RuleFileError(f"{where} must be a list")
    return node.value


def _plain(node):
    if type(node).__name__ == "ScalarNode":
        return node.value
    if _is_list(node) and len(node.value) == 2 and node.value[0].value == "env":
        return Call("env", (node.value[1].value,))
    raise RuleFileError("a text is expected here")


def _config(node):
    if _is_list(node) and not (node.value and getattr(node.value[0], "value", None) == "env"):
        return Vec(tuple(_config(v) for v in node.value))
    if type(node).__name__ == "ScalarNode" and node.style is None:
        return _scalar(node, loose=True)
    return _plain(node)


def _yaml_rule(kind: str, node) -> Call:
    parts = dict(_pairs(node, f"an item of {kind}"))
    known = {"sub", "ms", "when", "pipeline", "thread", "do", "form", "reentrant"}
    if odd := set(parts) - known:
        raise RuleFileError(f"unknown rule key {sorted(odd)[0]}")
    body_keys = [k for k in ("pipeline", "thread", "do", "form") if k in parts]
    if len(body_keys) != 1:
        raise RuleFileError("a rule has one of pipeline and do")
    key = body_keys[0]
    if key in ("pipeline", "thread"):
        body = Call("->", tuple(_expr(v) for v in _items(parts[key], key)))
    elif parts[key].flow_style is False and _is_list(parts[key]):
        body = Call("do", tuple(_expr(v) for v in parts[key].value))
    else:
        body = _expr(parts[key])
    if "when" in parts:
        body = Call("when", (_expr(parts["when"]), body))
    args: list = []
    if kind == "on":
        if "sub" not in parts:
            raise RuleFileError("an item of on needs sub")
        args.append(_plain(parts["sub"]))
    else:
        if "ms" not in parts:
            raise RuleFileError("an item of every needs ms")
        args += [Key("ms"), _scalar(parts["ms"], loose=False)]
    if "reentrant" in parts:
        args += [Key("reentrant"), _scalar(parts["reentrant"], loose=False)]
    return Call(kind, (*args, body))


def _scalar(node, loose: bool):
    if node.style is not None:
        return node.value
    word = node.value
    if word in ("null", "nil", "~", ""):
        return None
    if word in ("true", "false"):
        return word == "true"
    try:
        return float(word)
    except ValueError:
        pass
    if word.startswith("$"):
        return binding(word[1:])
    if loose:
        return word
    if word in OPTION_WORDS:
        return Key(word)
    raise RuleFileError(f"unquoted word {word}: write ${word}, quote it, or check its spelling" if word in BINDINGS else f"unquoted word {word}: quote it if it is text")


def _expr(node):
    if type(node).__name__ == "ScalarNode":
        return _scalar(node, loose=False)
    if not _is_list(node):
        raise RuleFileError("a map of options stands inside a call only")
    if not node.value:
        raise RuleFileError("an empty array is no call")
    head, *rest = node.value
    if type(head).__name__ != "ScalarNode":  # an array of arrays is a vector
        return Vec(tuple(_expr(v) for v in node.value))
    if head.style is not None and not rest:
        return Vec((head.value,))
    if head.style is not None and head.value not in FORMS_AS_TEXT:
        return Vec(tuple(_expr(v) for v in node.value))
    args: list = []
    for v in rest:
        if type(v).__name__ == "MappingNode":
            if not v.value:
                raise RuleFileError("a map of options isn't empty")
            for name, value in _pairs(v, "options"):
                args.append(Key(name))
                if not (name == "leaf" and value.value == "true"):
                    args.append(_expr(value))
        else:
            args.append(_expr(v))
    return Call(head.value, tuple(args))


#: Names of forms that YAML makes one quote.
FORMS_AS_TEXT = frozenset([">", "<", ">=", "<=", "=", "->", "-", "+", "*", "/", "!", "%"])

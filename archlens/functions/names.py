"""Names and identities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hooks that come with the UI library and with the router.
BUILTIN_HOOKS = [
    "useState", "useEffect", "useCallback", "useMemo", "useRef", "useReducer", "useContext", "useTransition",
    "useDeferredValue", "useId", "useLayoutEffect", "useImperativeHandle", "useDebugValue", "useSyncExternalStore",
    "useInsertionEffect", "useRouter", "usePathname", "useSearchParams", "useParams", "useSelectedLayoutSegment",
    "useSelectedLayoutSegments", "useReportWebVitals",
]
#: File names with a meaning of their own.
SPECIAL_FILES = ["page", "layout", "loading", "error", "template"]


def canonical_id(path: Column, name: Column) -> Column:
    return F.concat_ws("#", path, name)


def id_path(identity: Column) -> Column:
    """What stands before the last ``#``; all of it without one."""
    return F.when(F.instr(identity, "#") == 0, identity).otherwise(F.regexp_extract(identity, r"(?s)^(.*)#[^#]*$", 1))


def id_name(identity: Column) -> Column:
    """What stands behind the last ``#``; ``default`` without one."""
    return F.when(F.instr(identity, "#") == 0, "default").otherwise(F.substring_index(identity, "#", -1))


def is_component_name(name: Column) -> Column:
    """The part before a dot begins like a component and isn't all capitals."""
    head = F.substring_index(name, ".", 1)
    return head.rlike("^[A-Z][a-zA-Z0-9]*") & ~head.rlike("^[A-Z_]+$")


def is_builtin_hook(name: Column) -> Column:
    return name.isin(BUILTIN_HOOKS)


def pascal_case(text: Column) -> Column:
    """Words between ``-`` and ``_`` joined, the first letter of each raised and the rest as it is."""
    return F.array_join(F.transform(F.split(text, "[-_]"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), "")


def base_name(path: Column) -> Column:
    """The file's name without folder and extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.(tsx?|jsx?)$", "")


def inferred_name(path: Column) -> Column:
    """The name of a file's default export: a special file is named after its folder too."""
    base = base_name(path)
    folder = F.regexp_replace(F.coalesce(F.get(F.split(path, "/"), F.size(F.split(path, "/")) - 2), F.lit("")), r"[()]", "")
    return F.when(base.isin(SPECIAL_FILES), F.concat(pascal_case(folder), pascal_case(base))).otherwise(pascal_case(base))

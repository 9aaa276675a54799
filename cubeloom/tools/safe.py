"""Whether a statement only reads, by Spark's own parser."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Beginnings of the names of plan nodes that write, define or run commands.
_WRITING = ("Insert", "Create", "Drop", "Alter", "Truncate", "Delete", "Update", "Merge", "Replace", "Set", "Reset", "Refresh", "Cache", "Uncache", "Load", "Rename", "Repair", "Analyze", "Add", "Recover", "Comment", "Overwrite", "Append", "Script", "Execute", "Declare", "Use", "Clear")


def is_read_only(spark: SparkSession, sql: str) -> bool:
    """True for one statement whose whole plan, subqueries included, only reads."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception:  # what cannot be parsed is not known to be safe
        return False
    todo = [plan]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith(_WRITING) or name.endswith(("Command", "Statement")):
            return False
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        inner = node.innerChildren()
        for i in range(inner.size()):
            child = inner.apply(i)
            if hasattr(child, "nodeName"):
                todo.append(child)
    return True

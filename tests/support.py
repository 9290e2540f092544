"""What tests read from a table."""


def cells(table, column_id):
    """A column's values in row order."""
    return [r[column_id] for r in table.sorted_df().select(column_id).collect()]


def fills(table, column_id):
    name = f"__fill__{column_id}"
    if column_id not in table.fills:
        return [None] * table.df.count()
    return [r[name] for r in table.sorted_df().select(name).collect()]

def columns_kept(found, docs):
    """Whether a stage gives the columns that it got."""
    return found.columns == docs.columns and [f.dataType for f in found.schema] == [f.dataType for f in docs.schema]

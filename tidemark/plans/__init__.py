"""Query registry, declared filters, paging and cursors."""

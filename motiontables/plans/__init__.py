"""Named queries over the warehouse tables, with their reference SQL."""

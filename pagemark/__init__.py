"""pagemark: web pages, captured responses, render snapshots and request logs
to Markdown and policy decisions, as Spark DataFrame / SQL / Structured
Streaming jobs. ``pagemark.api.convert`` runs the whole cascade."""

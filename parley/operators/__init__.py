"""DataFrame -> DataFrame operators.  Group is always a key, so one chat and
many thousand chats go through the same plan."""

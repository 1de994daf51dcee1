"""Spark-native analytics for exported group chats."""

__all__ = ["ChatAnalysis", "get_session"]


def __getattr__(name):
    # Python workers import this package too: keep that cheap
    if name == "ChatAnalysis":
        from parley.plans.analysis import ChatAnalysis

        return ChatAnalysis
    if name == "get_session":
        from parley.session import get_session

        return get_session
    raise AttributeError(name)

from launch import LaunchDescription
from launch_ros.actions import Node


def generate_launch_description():
    return LaunchDescription([
        Node(package="demo", executable="speaker", name="speaker_a"),
        Node(package="demo", executable="speaker", name="speaker_b"),
        Node(package="demo", executable="hearer", name="hearer"),
        Node(package="demo", executable="alone", name="alone"),
        Node(package="demo", executable="shout", name="shout"),
        Node(package="demo", executable="wait", name="wait"),
        Node(package="demo", executable="fast_cam", name="fast_cam"),
        Node(package="demo", executable="strict_view", name="strict_view", remappings=[("image", "/camera/image")]),
        OpaqueFunction(function=lost),
    ])
